import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from planwright.llm import exact_dedup as ed


def brute(corpus):
    groups = defaultdict(list)
    for r in corpus:
        groups[r[1] or ""].append(r[0])
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((r[0], keep[r[1] or ""], len(groups[r[1] or ""]), r[0] == keep[r[1] or ""], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in corpus), key=repr)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_same_as_brute_force(corpus, docs, clashing):
    assert result(ed.exact_dedup(docs)) == brute(corpus)
    assert result(ed.exact_dedup(clashing, batches=3)) == brute(corpus)


def test_without_filters_and_with_clashing_digests(corpus, docs, monkeypatch):
    monkeypatch.setattr(ed, "FILTER_BYTES", -1)
    weak = lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 2))  # noqa: E731 - many texts for one digest
    assert result(ed.exact_dedup(docs, digest=weak)) == brute(corpus)


def test_empty(nothing):
    assert ed.exact_dedup(nothing).count() == 0


def test_fuse_filter():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 500, 33_000):
        keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
        f = ed.BinaryFuseFilter.from_bytes(ed.BinaryFuseFilter.build(keys).to_bytes())
        assert f.contains(keys).all()
        other = rng.integers(0, 1 << 63, 50_000).astype(np.uint64)
        assert f.contains(other).mean() < 0.01
        assert n < 10_000 or len(f.to_bytes()) < 1.3 * n


def test_screen_keeps_all_that_is_held(spark, docs):
    rows = docs.select(ed.sha256(F.coalesce("text", F.lit(""))).alias("digest")).distinct()
    half = ed.written(rows.filter(F.pmod(F.xxhash64("digest"), F.lit(2)) == 0).select("digest", F.lit(1).cast("long").alias("keep"), F.lit(1).cast("long").alias("n")), "half")
    snap = ed.Snapshot.of(half)
    hit = snap.screen(rows.select("digest"))
    assert half.join(hit, "digest", "left_anti").count() == 0
    assert hit.count() < rows.count()
