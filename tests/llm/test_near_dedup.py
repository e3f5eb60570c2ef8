import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from planwright.llm import near_dedup as nd
from planwright.llm.components import components
from planwright.llm.tokens import word_hashes as words


def shingle_set(t, k):
    w = (t or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, num, den):
    sets = [shingle_set(r[1], k) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    smallest = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            smallest[find(i)] = min(smallest.get(find(i), r[0]), r[0])
    out = [(r[0], len(s), c, c == r[0]) for i, (r, s) in enumerate(zip(rows, sets)) for c in [smallest.get(find(i)) if s else r[0]]]
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def near_rows():
    """A group of near copies around the threshold, beside copies and strangers."""
    rng = random.Random(2)
    base = ["w%d" % rng.randrange(400) for _ in range(120)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = "e%d" % rng.randrange(1000)
        rows.append((500 - i, " ".join(w)))
    rows += [(1000 + i, " ".join("s%d" % rng.randrange(900) for _ in range(80))) for i in range(20)]
    return rows + [(2000, rows[3][1]), (2001, rows[3][1].upper())]


@pytest.mark.parametrize("k", [4, 5])
def test_same_as_brute_force(corpus, docs, k):
    assert result(nd.near_dedup(docs, k=k)) == brute(corpus, k, 80, 100)


def test_borderline_group_in_small_blocks(spark, monkeypatch):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows, 4, 80, 100)
    assert len({r[2] for r in expected}) > 25
    assert result(nd.near_dedup(df, k=4)) == expected
    monkeypatch.setattr(nd, "BLOCK", 8)
    assert result(nd.near_dedup(df, k=4)) == expected


def test_clashing_columns_and_empty(corpus, clashing, nothing):
    assert result(nd.near_dedup(clashing, k=4)) == brute(corpus, 4, 80, 100)
    assert nd.near_dedup(nothing).count() == 0


def test_every_pair_within_the_bound_shares_a_key():
    rng = np.random.default_rng(0)
    bound = nd.distance_bound(0.8)
    errors = bound // nd.CHUNKS
    for _ in range(300):
        a = rng.integers(0, 1 << 16, nd.SYMBOLS).astype(np.uint16)
        b = a.copy()
        at = rng.choice(nd.SYMBOLS, bound, replace=False)
        b[at] ^= 1
        keys = nd.index_keys(np.stack([a, b]), errors)
        assert (keys[0] == keys[1]).any()
        first = nd.first_key((a == b)[None], errors)[0]
        assert first == np.flatnonzero(keys[0] == keys[1])[0]


def test_words_follow_ascii_rules():
    assert (words("A b\x0bC d É".encode()) == words("a\tB c d É".encode())).all()
    assert len(words("A b\x0bC d É".encode())) == 4 and words("É".encode())[0] != words("é".encode())[0]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_second_level_keys_in_small_blocks(spark, monkeypatch):
    rows = near_rows()[:30]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(nd, "BLOCK", 8)
    monkeypatch.setattr(nd, "second_count", lambda bound: 0)
    assert result(nd.near_dedup(df, k=4)) == brute(rows, 4, 80, 100)


def test_every_pair_within_the_bound_shares_a_key_of_each_level():
    rng = np.random.default_rng(1)
    bound = nd.distance_bound(0.8)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, nd.SYMBOLS).astype(np.uint16)
        b = a.copy()
        b[rng.choice(nd.SYMBOLS, bound, replace=False)] ^= 1
        sig, equal = np.stack([a, b]), (a == b)[None]
        first = int(nd.first_key(equal, bound // nd.CHUNKS)[0])
        key = nd.index_keys(sig, bound // nd.CHUNKS)[:, first]
        assert key[0] == key[1]
        found, number = nd.second_keys(sig, key, np.array([first, first]), bound)
        assert ((number >= 0).sum(axis=1) == nd.second_count(bound)).all()
        shared = number[0][(found[0] == found[1]) & (number[0] >= 0)]
        assert len(shared) and sum(nd.claimed(equal, np.array([i]), bound, True)[0] for i in shared) == 1


def test_unlike_classes_under_one_key_stay_linear(spark):
    """50,000 classes that agree in one chunk and nothing else: rows, and none of them in one task."""
    n, bound = 50_000, nd.distance_bound(0.8)
    sig = np.random.default_rng(4).integers(0, 1 << 16, (n, nd.SYMBOLS)).astype(np.uint16)
    sig[:, :4] = 7
    classes = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sig)], "cls long, sig binary").repartition(8).cache()
    members = nd._members(classes, bound // nd.CHUNKS)
    per_key = members.groupBy("key").count().orderBy("count", ascending=False).limit(5).collect()
    assert [r["count"] for r in per_key[:4]] == [n] * 4 and all(r["count"] < 50 for r in per_key[4:])
    one = members.filter(f"key = {per_key[0]['key']}").select("key", "index", "cls")
    second = nd._second_members(one, classes, bound)
    assert second.count() < n  # of 90 n keys, those that two classes share by chance


def test_a_settled_group_meets_strangers_only(spark):
    """5,000 classes of one component and 40 others, 10 blocks: linear, and every pair across once."""
    rows = spark.range(5040).select(F.lit(1).cast("long").alias("key"), F.lit(0).alias("index"), F.col("id").alias("cls"), F.when(F.col("id") < 5000, 3).otherwise(F.col("id")).alias("comp"), F.lit(3).cast("long").alias("main"), F.lit(10).alias("bm"), F.lit(2).alias("bt"))
    units = nd._paired(rows).cache()
    assert units.filter("cls < 5000").count() == 2 * 5000 and units.filter("cls >= 5000").count() == 40 * 12
    a, b = units.alias("a"), units.alias("b")
    on = (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j")) & (F.col("a.cls") < F.col("b.cls")) & (F.col("a.comp") != F.col("b.comp"))
    same = (F.col("a.i") < 0) & (-1 - F.col("a.i") == F.col("a.j"))
    met = a.join(b, on).filter(same | (F.col("a.side") != F.col("b.side"))).select(F.col("a.cls").alias("x"), F.col("b.cls").alias("y"))
    assert met.count() == met.distinct().count() == 5000 * 40 + 40 * 39 // 2


def test_one_row_of_each_group_stays(spark, docs, corpus):
    texts = [r[1] for r in corpus]
    groups = {r[0]: r[2] for r in brute(list(enumerate(texts)), 5, 80, 100)}
    for ident in ("null", "5", "id"):
        rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr(f"cast({ident} as long) as doc_id", "text", "id as row", "1 as th")
        rows = rows.unionByName(rows.filter("row < 40"))
        out = nd.one_of_each(rows)
        assert out.columns == rows.columns
        left = [r.row for r in out.collect()]
        some = [i for i in left if (texts[i] or "").split()]
        assert len(some) == len({groups[i] for i in some}) == len({groups[i] for i, t in enumerate(texts) if (t or "").split()})
        if ident == "id":  # rows without words are in no group
            assert len(left) - len(some) == sum(not (t or "").split() for t in texts)
    same = spark.range(50_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same words in every row of it").alias("text"))
    assert nd.one_of_each(same).count() == 1

