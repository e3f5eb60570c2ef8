"""Exact deduplication with static binary-fuse filters over immutable snapshots.

A corpus arrives in batches. Every batch is first grouped by digest on its own, so copies
inside it meet before anything else is asked (and a hot text shrinks to one row per task).
Its distinct digests are then screened by the binary-fuse filters of the earlier snapshots:
a negative answer is certain, so most digests go no further; positives join the exact buckets
of those snapshots. What shares a digest is at last compared byte for byte.

Defined results: null text counts as empty; a null id sorts below every number; rows that
repeat both id and text each count in ``group_size`` and share one decision; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planwright.llm.common import documents, written

#: Distinct digests that share one filter: bounds the memory of a build and of a probe.
KEYS_PER_BUCKET = 32_768
#: Up to this size together, the filters of shared digests are sent to every task.
FILTER_BYTES = 64 << 20
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
    for m in (_M1, _M2):
        h = (h ^ (h >> np.uint64(33))) * m
    return h ^ (h >> np.uint64(33))


class BinaryFuseFilter:
    """Immutable set of 64-bit keys with 8-bit fingerprints, about 9 bits a key
    (3-wise binary fuse, Graf and Lemire 2022). No false negatives; false positives 1/256."""

    def __init__(self, seed: int, segment: int, segments: int, slots: np.ndarray):
        self.seed, self.segment, self.segments, self.slots = seed, segment, segments, slots

    @staticmethod
    def _where(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
        first = ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)) * np.uint64(segment)
        mask = np.uint64(segment - 1)
        return np.stack([first + (h & mask), first + np.uint64(segment) + ((h >> np.uint64(16)) & mask), first + np.uint64(2 * segment) + ((h >> np.uint64(8)) * _M1 >> np.uint64(40) & mask)]).astype(np.int64)

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32))) * _M2 >> np.uint64(56)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> "BinaryFuseFilter":
        keys = np.unique(np.asarray(keys, np.uint64))
        n = len(keys)
        segment = 1 << max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
        wanted = int(max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2))) * n) + 2 * segment
        segments = max(1, -(-wanted // segment) - 2)
        for seed in range(1, 200):
            if seed % 20 == 0:  # small sets at times need a little more room
                segments += max(1, segments // 8)
            h = _mix(keys, seed)
            at = cls._where(h, segment, segments)
            order = cls._peel(at, (segments + 2) * segment)
            if order is not None:
                slots = np.zeros((segments + 2) * segment, np.uint8)
                prints = cls._print(h)
                for ids, free in reversed(order):  # keys of one round do not share their free slots
                    slots[free] = prints[ids] ^ slots[at[0, ids]] ^ slots[at[1, ids]] ^ slots[at[2, ids]]
                return cls(seed, segment, segments, slots)
        raise RuntimeError("no seed gave a peelable layout")

    @staticmethod
    def _peel(at: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        n = at.shape[1]
        count = np.bincount(at.ravel(), minlength=size)
        which = np.zeros(size, np.int64)  # xor of the keys in a slot: the key itself once it is alone
        ids = np.arange(n)
        for row in at:
            np.bitwise_xor.at(which, row, ids)
        done, order = np.zeros(n, bool), []
        free = np.flatnonzero(count == 1)
        while len(free):
            keys, first = np.unique(which[free], return_index=True)
            free = free[first]
            order.append((keys, free))
            done[keys] = True
            gone = at[:, keys]
            for row in gone:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(which, row, keys)
            touched = np.unique(gone)
            free = touched[count[touched] == 1]
        return order if done.all() else None

    def __contains__(self, key: int) -> bool:
        return bool(self.contains(np.array([key], np.uint64))[0])

    def contains(self, keys: np.ndarray) -> np.ndarray:
        h = _mix(np.asarray(keys, np.uint64), self.seed)
        a, b, c = self._where(h, self.segment, self.segments)
        return self._print(h) == (self.slots[a] ^ self.slots[b] ^ self.slots[c])

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], np.int64).tobytes() + self.slots.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "BinaryFuseFilter":
        seed, segment, segments = (int(x) for x in np.frombuffer(raw[:24], np.int64))
        return cls(seed, segment, segments, np.frombuffer(raw, np.uint8, offset=24))


def _keys(digests: Iterable[bytes]) -> np.ndarray:
    raw = b"".join(bytes(d[:8]).ljust(8, b"\0") for d in digests)
    return np.frombuffer(raw, np.uint64)


@dataclass(frozen=True)
class Snapshot:
    """An immutable run of digests: ``rows`` (digest, keep, n), ``filters`` (bucket, filter)."""

    rows: DataFrame
    filters: DataFrame
    buckets: int

    @classmethod
    def of(cls, rows: DataFrame) -> "Snapshot":
        """``rows`` (digest, keep, n) with one row for each digest, in a table that stays."""
        buckets = max(1, -(-rows.count() // KEYS_PER_BUCKET))

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"bucket": pdf.bucket[:1], "filter": [BinaryFuseFilter.build(_keys(pdf.digest)).to_bytes()]})

        keyed = rows.select(bucket_of("digest", buckets).alias("bucket"), "digest")
        filters = keyed.groupBy("bucket").applyInPandas(build, "bucket long, filter binary")
        return cls(rows, written(filters, "fuse"), buckets)

    def screen(self, digests: DataFrame) -> DataFrame:
        """The rows of ``digests`` (digest, ...) that may be in the snapshot."""
        schema = digests.schema
        keyed = digests.withColumn("bucket", bucket_of("digest", self.buckets))

        def probe(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            own = own.drop(columns="bucket")
            if not len(held) or not len(own):
                return own[:0]
            return own[BinaryFuseFilter.from_bytes(held["filter"].iloc[0]).contains(_keys(own.digest))]

        return keyed.groupBy("bucket").cogroup(self.filters.groupBy("bucket")).applyInPandas(probe, schema)


def bucket_of(digest: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(buckets))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def screened(rows: DataFrame, digests: DataFrame) -> DataFrame:
    """``rows`` (with a column digest) without most of those whose digest is not in ``digests``.

    The filters of ``digests`` go to every task if they are at most ``FILTER_BYTES`` together;
    beyond that all rows stay, and the join that follows moves them by digest.
    """
    held = Snapshot.of(digests)
    if (held.filters.agg(F.sum(F.length("filter"))).first()[0] or 0) > FILTER_BYTES:
        return rows
    filters = rows.sparkSession.sparkContext.broadcast({r["bucket"]: r["filter"] for r in held.filters.collect()})
    at, place = len(rows.columns), rows.columns.index("digest")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = {b: BinaryFuseFilter.from_bytes(f) for b, f in filters.value.items()}
        for batch in batches:
            own = batch.column(at).to_numpy(zero_copy_only=False)
            keys = _keys(batch.column(place).to_pylist())
            hit = np.zeros(len(own), bool)
            for b in np.unique(own):
                if b in opened:
                    hit[own == b] = opened[b].contains(keys[own == b])
            yield batch.filter(pa.array(hit)).select(list(range(at)))

    return rows.withColumn("__bucket", bucket_of("digest", held.buckets)).mapInArrow(probe, rows.schema)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id (largest id with the same text), group_size,
    kept, text_sha256. ``batches``: into how many arrivals, by a hash of the id, the table is cut."""
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    light = written(own.select("id", digest(F.col("text")).alias("digest"), F.sha2("text", 256).alias("sha"), F.pmod(F.xxhash64("id"), F.lit(batches)).alias("batch")), "digests")
    snapshots: list[Snapshot] = []
    merged = None
    for b in range(batches):
        new = written(light.filter(F.col("batch") == b).groupBy("digest").agg(F.max("id").alias("keep"), F.count("*").alias("n")), "batch")
        for old in snapshots:
            hits = old.screen(new).select("digest").join(old.rows.select("digest"), "digest", "left_semi")
            merged = hits if merged is None else merged.unionByName(hits)
        snapshots.append(Snapshot.of(new) if b + 1 < batches else Snapshot(new, new, 1))
    rows = snapshots[0].rows
    for s in snapshots[1:]:
        rows = rows.unionByName(s.rows)
    shared = rows.filter("n > 1").select("digest")
    shared = written((shared if merged is None else shared.unionByName(merged)).distinct(), "shared")

    # Byte checks: copies collapse map-side, so a hot text travels once for each task; only then
    # do the texts meet the digests that are shared.
    classes = screened(own.withColumn("digest", digest(F.col("text"))), shared)
    classes = classes.groupBy("digest", "text").agg(F.max("id").alias("keep"), F.count("*").alias("n"))
    classes = classes.join(shared.hint("merge"), "digest")  # distinct; a semi join would be moved below the grouping
    exact = written(classes.groupBy("digest").agg(F.max("keep").alias("keep"), F.max("n").alias("n"), F.count("*").alias("texts")), "classes")

    def answer(df: DataFrame) -> DataFrame:
        keep, size = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")), F.coalesce("n", F.lit(1)).cast("long")
        return df.select(F.col("id").alias(id_col), keep.alias("keep_id"), size.alias("group_size"), keep.eqNullSafe(F.col("id")).alias("kept"), F.col("sha").alias("text_sha256"))

    out = light.join(exact, "digest", "left")
    if exact.filter("texts > 1").isEmpty():
        return answer(out)
    # Different texts under one digest: their rows are told apart by the text itself.
    clash = exact.filter("texts > 1").select("digest")
    apart = own.withColumn("digest", digest(F.col("text"))).join(clash, "digest", "left_semi").withColumn("sha", F.sha2("text", 256))
    return answer(out.filter("texts is null or texts = 1")).unionByName(answer(apart.join(classes, ["digest", "text"])))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
