import hashlib
import random

from pyspark.sql import functions as F

from planwright.llm import fingerprint as fp


def edited(texts):
    """texts in the order of the query -> the edited text of each."""
    out = []
    for i, t in enumerate(texts):
        m = len(t) // 3
        out.append(t[: len(t) - m] + texts[(i + 1) % len(texts)][:m])
    return out


def test_query_columns_and_edits(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab cé\n🙂") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts[4] = None
    texts[9] = texts[8]
    spark.createDataFrame([(i * 7 % 40, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(fp, "ROWS_IN_ORDER", 6)
    got = {r.doc_id: r for r in fp.op1_syncmer_fingerprint(spark, str(tmp_path)).collect()}
    by_id = {i * 7 % 40: t or "" for i, t in enumerate(texts)}
    order = sorted(by_id, reverse=True)
    assert sorted(got) == sorted(order)
    for i, e in zip(order, edited([by_id[i] for i in order])):
        assert got[i].n_chars == len(by_id[i])
        assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    same = [got[8 * 7 % 40].fingerprint, got[9 * 7 % 40].fingerprint]
    assert same[0] == same[1]


def test_syncmers_are_closed_and_context_free(spark):
    rng = random.Random(5)
    words = ["w%d" % rng.randrange(50) for _ in range(300)]  # longer than SHORT: taken by words
    block = words[100:170]
    a, b = " ".join(words), "other text before " + " ".join(block) + " and after" + " that" * 20
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    hashes = {w: h for w, h in df.select(F.explode(F.split("text", " ")).alias("w")).distinct().select("w", F.xxhash64("w")).collect()}
    rows = fp.anchors(df).collect()
    place = {d: {r.pos: r.hash for r in rows if r.doc_id == d} for d in (1, 2)}
    inner = spark.createDataFrame([(i, hashes[x], hashes[y]) for i, (x, y) in enumerate(zip(words, words[1:]))], "i int, x long, y long").select("i", F.xxhash64("x", "y").alias("h")).collect()
    s = [h for _, h in sorted(inner)]
    expected = [i for i in range(len(words) - fp.K + 1) if min(s[i], s[i + 3]) <= min(s[i + 1 : i + 3])]
    assert sorted(place[1]) == expected
    # Inside the shared block the same anchors are chosen, at the same distance.
    inside = {p - 100: h for p, h in place[1].items() if 100 <= p <= 170 - fp.K}
    there = {p - 3: h for p, h in place[2].items() if 3 <= p <= 3 + 70 - fp.K}
    assert inside == there and len(inside) > 10


def test_likeness_separates_edits_from_strangers(spark, docs):
    got = docs.select("doc_id", "text", fp.sketch(F.col("text")).alias("s")).collect()
    by_text = {}
    for r in got:
        by_text.setdefault(r.text or "", set()).add(tuple(r.s))
    assert all(len(v) == 1 for v in by_text.values())
    pair = spark.createDataFrame([(list(a), list(b)) for a in ([1, 2, 3], []) for b in ([2, 3, 4], [], [1, 2, 3])], "a array<long>, b array<long>")
    assert [r[0] for r in pair.select(fp.likeness(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0, 1.0, 0.0, 1.0, 0.0]


def test_edges(docs, nothing, clashing):
    assert nothing.select(fp.sketch(F.col("text"))).count() == 0
    assert fp.with_next(nothing.select("doc_id", "text"), "doc_id", ["text"]).count() == 0
    out = fp.with_next(clashing.select("doc_id", "text"), "doc_id", ["text"])
    assert out.count() == docs.count() and out.filter("next_text is null").count() <= docs.filter("text is null").count()
    none = docs.filter("text is null or text rlike '^[ \\\\n]*$'").select(fp.spell(fp.sketch(F.col("text"))).alias("f")).collect()
    assert len(none) >= 4 and {r.f for r in none} == {""}


def test_fingerprint_and_likeness_by_brute_force(spark, corpus, tmp_path):
    """Sketches from the anchors, which another test holds against the definition, and the share of
    what both hold among the smallest of both."""
    texts = {j: t for j, (_, t, *_) in enumerate(corpus)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    order = sorted(texts, reverse=True)
    whole = {i: texts[i] or "" for i in order}
    changed = dict(zip(order, edited([whole[i] for i in order])))
    rows = [(f"t{i}", t) for i, t in whole.items()] + [(f"e{i}", t) for i, t in changed.items()]
    found = {}
    for r in fp.anchors(spark.createDataFrame(rows, "doc_id string, text string")).collect():
        found.setdefault(r.doc_id, set()).add((r.hash % (1 << 64)) >> 32)
    sketch = lambda n: sorted(found.get(n, ()))[:64]

    def likeness(a, b):
        both = sorted({*a, *b})[:64]
        return 1.0 if not both else len([x for x in both if x in a and x in b]) / len(both)

    got = {r.doc_id: r for r in fp.op1_syncmer_fingerprint(spark, str(tmp_path)).collect()}
    for k, i in enumerate(order):
        own, other, after = sketch(f"t{i}"), sketch(f"e{i}"), sketch(f"t{order[(k + 1) % len(order)]}")
        assert got[i].fingerprint == "".join(f"{x:08x}" for x in own) and got[i].edited_fingerprint == "".join(f"{x:08x}" for x in other)
        assert abs(got[i].near_edited - likeness(own, other)) < 1e-12 and abs(got[i].near_next - likeness(own, after)) < 1e-12
        if len(whole[i]) >= 30 and len(set(whole[i])) > 8:
            assert got[i].near_edited > 0.1  # two thirds of the characters are the same, in short texts too


def test_short_texts_and_long_strings_survive_an_edit(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(3000))
    pairs = [("one small note about it", "one small note about me"), ("internationalization", "internationalisation"), (long, long[:2000] + long[:1000][::-1])]
    df = spark.createDataFrame(pairs, "a string, b string")
    near = [r[0] for r in df.select(fp.likeness(fp.sketch(F.col("a")), fp.sketch(F.col("b")))).collect()]
    assert all(x > 0.3 for x in near), near
