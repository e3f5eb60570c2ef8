import random
from collections import Counter

import numpy as np
import pytest

from planwright.llm import language_id as li

KINDS = {"aa": ["the", "ing", "tion", "er", "wh"], "bb": ["über", "sch", "keit", "ein", "ß"], "cc": ["ção", "os", "lh", "ado", "ñ"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(KINDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    langs = sorted(KINDS)
    out = [(i, text(rng, langs[i % 3], rng.randint(3, 60)), langs[i % 3]) for i in range(300)]
    return out + [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !!", "cc"), (1003, "Ωψφ" * 60, None), (1004, text(rng, "bb", 4000), "bb"), (None, "the tion", None)]


@pytest.fixture(scope="module")
def table(spark, rows):
    from planwright.llm.common import importable

    importable(spark)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_probabilities_sum_to_one(rows):
    m = li.CharModels.fit({"aa": [t for _, t, x in rows[:30] if x == "aa"], "bb": ["ab abc abd"]})
    # After any context all known characters and the unseen one share the whole.
    alphabet = np.unique(np.concatenate([li.letters([t])[0] for _, t, x in rows[:30] if x == "aa"] + [li.letters(["ab abc abd"])[0]])).astype(np.uint64)
    for context in ("the", "ing", "abd", "qqq"):
        code = np.uint64(0)
        for ch in context:
            code = code << np.uint64(16) | np.uint64(ord(ch))
        p = np.exp(m.look((code << np.uint64(16)) | alphabet, 4).astype(float)).sum(axis=0)
        assert (p <= 1.0001).all() and (p > 0.6).all()


def kneser_ney(by_lang, order=4):
    """Interpolated Kneser-Ney by dictionaries: p(lang, context, character), context of any length."""
    size = len({c for texts in by_lang.values() for t in texts for c in " " + t})
    models = {}
    for lang, texts in by_lang.items():
        seen = [Counter() for _ in range(order + 1)]
        for t in texts:
            t = " " + t
            for n in range(1, order + 1):
                seen[n].update(t[i : i + n] for i in range(len(t) - n + 1))
        counts = [None] * (order + 1)
        counts[order] = dict(seen[order])
        for n in range(order - 1, 0, -1):  # kinds of characters before; 1 where there is none
            kinds = Counter(g[1:] for g in counts[n + 1])
            counts[n] = {g: kinds.get(g, 1) for g in {*kinds, *seen[n]}}
        models[lang] = counts

    def p(lang, context, c):
        counts, n = models[lang], len(context) + 1
        if n == 1 and not c:
            return 1 / (size + 1)
        lower = p(lang, context[1:], c) if n > 1 else 1 / (size + 1)
        own = counts[n]
        n1, n2 = (sum(v == k for v in own.values()) for k in (1, 2))
        cut = min(0.95, max(0.1, n1 / max(1, n1 + 2 * n2)))
        after = {g: v for g, v in own.items() if g[:-1] == context}
        total = sum(after.values())
        if not total:
            return lower
        return (max(own.get(context + c, 0) - cut, 0) if context + c in own else 0) / total + cut * len(after) / total * lower

    return p


def test_same_as_kneser_ney_by_dictionaries(rows):
    by_lang = {x: [t for _, t, y in rows[:24] if y == x] for x in ("aa", "cc")}
    by_lang["zz"] = ["ab", "a", "abc abd", "b a"]
    m, p = li.CharModels.fit(by_lang), kneser_ney(by_lang)
    text = "the ing ção abd aba"
    for i in range(3, len(text)):
        gram = text[i - 3 : i + 1]
        code = 0
        for ch in gram:
            code = code << 16 | ord(ch)
        got = np.exp(m.look(np.array([code], np.uint64), 4)[0].astype(float))
        known = any(gram[-1] in " " + t for texts in by_lang.values() for t in texts)
        assert known
        for lang, value in zip(m.langs, got):
            assert abs(value - p(lang, gram[:3], gram[3])) < 1e-5, (lang, gram)


def test_cross_entropy_is_that_of_the_text(rows):
    by_lang = {"aa": [t for _, t, y in rows[:24] if y == "aa"]}
    m, p = li.CharModels.fit(by_lang), kneser_ney(by_lang)
    text = "the ing tion"
    whole = " " + text
    expected = -sum(np.log(p("aa", whole[max(0, i - 3) : i], whole[i])) for i in range(1, len(whole))) / len(text)
    ce, n = m.entropy([text])
    assert n[0] == len(text) and abs(ce[0, 0] - expected) < 1e-4


def test_held_out_accuracy_and_rejection(table, rows):
    models = li.learn(table.filter(~li.held_out("doc_id")))
    out = li.identify(table, models)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "lang_score", "rejected"]
    got = {r.doc_id: r for r in out.collect()}
    known = [r for r in rows[:300]]
    assert np.mean([got[i].lang_pred == lang for i, _, lang in known]) > 0.97
    assert not any(got[i].rejected for i, _, _ in known)
    for i in (1000, 1001, 1002):
        assert got[i].lang_pred == "und" and got[i].lang_score == 0 and got[i].rejected
    assert got[1003].rejected and got[1003].lang_pred in KINDS
    assert got[1004].lang_pred == "bb" and all(0 <= r.lang_score <= 1 for r in got.values())


def test_a_language_that_was_not_learnt_is_rejected(table, rows):
    models = li.learn(table.filter("lang <> 'cc'"))
    got = {r.doc_id: r for r in li.identify(table, models).collect()}
    strangers = [i for i, t, lang in rows[:300] if lang == "cc" and len(t) >= 100]
    assert np.mean([got[i].rejected for i in strangers]) > 0.9
    assert np.mean([got[i].rejected for i, _, lang in rows[:300] if lang != "cc"]) < 0.02


def test_the_sample_is_bounded_whatever_the_ids_and_lengths(spark, table):
    from pyspark.sql import functions as F

    hot = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text again").alias("text"), F.lit("aa").alias("lang"))
    many = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"), F.lit("bb").alias("lang"))
    long = spark.createDataFrame([(1, "über ein " * 20_000, "dd"), (2, "ção " * 3, "dd")], "doc_id long, text string, lang string")
    sample = li.drawn(hot.unionByName(many).unionByName(long), "text", "lang", 100, 150_000).collect()
    found = Counter(r.lang for r in sample)
    assert found["aa"] == 1 and found["bb"] == 100 and 1 <= found["dd"] <= 2
    assert li.learn(long).langs == ["dd"]


def test_result_names_and_values_of_the_input_stay(table):
    from pyspark.sql import functions as F

    mine = table.withColumns({c: F.lit("mine") for c in ("lang_pred", "REJECTED", "lang_score")})
    out = li.identify(mine, li.learn(table))
    assert out.columns == [*mine.columns, "lang_pred_", "lang_score_", "rejected_"]
    assert out.select("lang_pred", "REJECTED", "lang_score").distinct().collect() == [("mine",) * 3]


def test_long_texts_in_steps_score_the_same(rows, monkeypatch):
    m = li.CharModels.fit({x: [t for _, t, y in rows[:60] if y == x] for x in KINDS})
    long = " ".join(t for _, t, _ in rows[:200])
    whole = m.entropy([long, "the"])
    monkeypatch.setattr(li, "BLOCK", 500)
    parts = m.entropy([long, "the"])
    assert np.allclose(whole[0], parts[0], atol=0.05)
    assert m.predict([long])[0] == m.predict([long])[0]


def test_edges(spark, table, nothing):
    none = li.learn(nothing)
    assert {r.lang_pred for r in li.identify(table, none).collect()} == {"und"}
    models = li.learn(table)
    assert li.identify(nothing, models).count() == 0
    wide = table.selectExpr("*", "1 as c0", "2 as c1", "3 as n", "4 as h")
    assert li.identify(wide, models).count() == table.count()
