import math
import zlib
from collections import Counter

import numpy as np

from planwright.llm import bloom_lm as lm


def words(t):
    return [*(t or "").encode().lower().split(), None]


def training(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 != 0


def check(corpus, df):
    c = Counter(w for r in corpus if training(r[0]) for w in words(r[1]))
    n, v = sum(c.values()), len(c)
    got = Counter()
    for r in df.collect():
        got[r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.held_out, round(r.base_score, 6)] += 1
    expected = Counter()
    for i, t, *_ in corpus:
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))
        expected[i, len(words(t)), sum(c[w] > 0 for w in words(t)), n, not training(i), round(base, 6)] += 1
    assert got == expected


def test_base_is_exact_in_one_and_in_many_segments(corpus, docs, clashing, monkeypatch):
    check(corpus, lm.score(docs, lm.in_training("doc_id")))
    monkeypatch.setattr(lm, "SEGMENT_TEXT", 1 << 10)
    check(corpus, lm.score(clashing, lm.in_training("doc_id")))


def test_nothing_to_learn_from(docs, nothing):
    from pyspark.sql import functions as F

    rows = lm.score(docs, F.lit(False)).collect()
    assert len(rows) == docs.count() and all(r.train_tokens == 0 and r.n_known == 0 for r in rows)
    assert lm.score(nothing, lm.in_training("doc_id")).count() == 0


def by_hand(rows, mu, nu):
    return [sum(map(math.log10, p)) for p in probabilities(rows, mu, nu)]


def probabilities(rows, mu, nu):
    """The model of the docstring from exact counts: of each text those of its tokens."""
    c, pairs, triples, texts = Counter(), Counter(), Counter(), 0
    for learnt, t in rows:
        if learnt:
            ws = ["<s>", *words(t)]
            texts += 1
            c.update(ws[1:])
            pairs.update(zip(ws, ws[1:]))
            triples.update(zip(ws, ws[1:], ws[2:]))
    n, v = sum(c.values()), len(c)
    low = lambda k: float(lm.level_range(lm.levels(np.array([k])))[0][0]) if k else 0.0
    high = lambda k: float(lm.level_range(lm.levels(np.array([k])))[1][0]) if k else 0.0
    out = []
    for _, t in rows:
        own = []
        ws = ["<s>", *words(t)]
        for i in range(1, len(ws)):
            context = texts if i == 1 else c[ws[i - 1]]
            p = (low(pairs[ws[i - 1], ws[i]]) + mu * (c[ws[i]] + 0.1) / (n + 0.1 * (v + 1))) / (context + mu)
            if i > 1:
                context = high(pairs[ws[i - 2], ws[i - 1]])
                p = (low(triples[ws[i - 2], ws[i - 1], ws[i]]) + nu * p) / (context + nu)
            own.append(p)
        out.append(own)
    return out


def test_scores_are_sums_of_smoothed_probabilities(spark):
    df = spark.createDataFrame([(1, "a b a b a c"), (2, "a b d")], "doc_id long, text string")
    from pyspark.sql import functions as F

    got = {r.doc_id: r.score for r in lm.score(df, F.col("doc_id") == 1, mu=5.0, nu=2.0).collect()}
    expected = by_hand([(True, "a b a b a c"), (False, "a b d")], 5.0, 2.0)
    assert abs(got[1] - expected[0]) < 1e-9 and abs(got[2] - expected[1]) < 1e-9


def test_probabilities_after_a_context_sum_to_at_most_one(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(30)]
    trained = [" ".join(rng.choice(vocabulary, 60, p=np.arange(30, 0, -1) / 465)) for _ in range(40)]
    prefix = trained[0].split()[:5]
    rows = [(i, t) for i, t in enumerate(trained)] + [(1000 + i, " ".join([*prefix, w])) for i, w in enumerate(vocabulary)] + [(2000, " ".join(prefix))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = [(i < 1000, t) for i, t in rows]
    got = [r.score for r in lm.score(df, F.col("doc_id") < 1000, mu=5.0, nu=2.0).orderBy("doc_id").collect()]
    assert np.allclose(got, by_hand(texts, 5.0, 2.0), rtol=0.02)
    after = [p[len(prefix)] for p in probabilities(texts, 5.0, 2.0)[40:]]  # of each word, and of the end
    assert len(after) == 31 and 0.5 < sum(after) <= 1


def test_model_beats_base_on_repeated_text(docs):
    rows = [r for r in lm.score(docs, lm.in_training("doc_id")).collect()]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_levels_and_filter():
    counts = np.arange(1, 5000)
    low, high = lm.level_range(lm.levels(counts))
    assert ((low <= counts) & (counts <= high) & (high <= 1.5 * low)).all() and low[0] == high[0] == 1
    rng = np.random.default_rng(0)
    codes = np.unique(rng.integers(0, 1 << 63, 40_000).astype(np.uint64))
    n = rng.integers(1, 300, len(codes))
    bloom = lm.LogBloom.of(codes, n)
    level = bloom.level(codes)
    assert (level >= lm.levels(n)).all() and (level == lm.levels(n)).mean() > 0.95
    other = rng.integers(1 << 63, (1 << 64) - 1, 40_000, dtype=np.uint64)
    assert (bloom.level(other) > 0).mean() < 0.03  # false positives
    assert lm.LogBloom.of(codes[:0], n[:0]).level(codes).max() == 0


def test_nothing_is_left_out_however_much_there_is(spark, monkeypatch):
    """Many segments and chunks, hundreds of thousands of n-grams: the score is that of exact counts."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(lm, "SEGMENT_TEXT", 1 << 14)
    monkeypatch.setattr(lm, "GATHER", 1 << 14)
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(map(str, rng.integers(0, 3000, 6000)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in lm.score(df, F.lit(True), mu=5.0, nu=2.0).collect()}
    expected = by_hand([(True, t) for _, t in rows], 5.0, 2.0)
    for i, _ in rows:
        assert abs(got[i] - expected[i]) < 0.01 * abs(expected[i])


def test_a_third_of_the_rows_is_one_text(spark):
    from pyspark.sql import functions as F

    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.lit(7)).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same text here")).otherwise(F.concat(F.lit("row "), "id")).alias("text"))
    out = lm.score(rows, lm.in_training("doc_id"))
    assert out.filter("doc_id is null").agg(F.count("*"), F.countDistinct("score")).first() == (3000, 1)
