"""Conflict-constrained best-fit packing of documents into bins of a fixed number of tokens.

Bins are kept in the order of their residual room. A document goes to the tightest bin that takes
it: the search begins at the least residual that is enough and moves to successors until one has a
compatible bin. Each bin carries a bitmap of the sources that are full in it (``per_source`` documents
each) and one of the duplicate clusters in it that are frequent in the shard; bins of one residual and
equal bitmaps stand together and are passed over at once, so a hot source or cluster does not lengthen
the search. A rare cluster is looked up in the bin itself. Two documents of one cluster never share
a bin. Clusters are documents of equal words, or what ``cluster_col`` says.

Documents are dealt into shards of about ``SHARD`` rows by a hash of the row, so one packing is
bounded whatever repeats, and shards are packed in parallel, longest document first. A document
longer than a bin fills whole bins of its own and is packed with its rest.

Defined results: a text has its words and one end as tokens, so null or empty text is one token;
a null source is a source of its own; documents of one cluster (equal words, A-Z lower-cased) keep
apart, empty texts included; repeated rows are packed each; ties go by id, then by row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwright.llm.common import documents, importable, shuffle_parts, written
from planwright.llm.tokens import raw, small

#: Rows of a shard, about; members from which on a cluster has a bit of its own; bytes of a text that
#: are words at once, about.
SHARD, FREQUENT, SLICE = 8192, 8, 1 << 16

_SPACE = re.compile(rb"[ \t-\r]")


class Bin:
    __slots__ = ("number", "used", "full", "frequent", "rare", "counts")

    def __init__(self, number: int):
        self.number, self.used, self.full, self.frequent = number, 0, 0, 0
        self.rare: set[int] = set()
        self.counts: dict[int, int] = {}


class Room:
    """Open bins by residual, and among those of one residual by their bitmaps (full sources,
    frequent clusters): numbers in order."""

    def __init__(self) -> None:
        self.residuals: list[int] = []
        self.kinds: dict[int, dict[tuple[int, int], list[int]]] = {}

    def add(self, residual: int, own: Bin) -> None:
        kinds = self.kinds.get(residual)
        if kinds is None:
            kinds = self.kinds[residual] = {}
            insort(self.residuals, residual)
        insort(kinds.setdefault((own.full, own.frequent), []), own.number)

    def take(self, rest: int, source: int, bit: int, cluster: int, bins: dict[int, Bin]) -> tuple[int, Bin] | None:
        """The tightest compatible bin, taken out; of equally tight ones the first made."""
        for at in range(bisect_left(self.residuals, rest), len(self.residuals)):
            residual = self.residuals[at]
            kinds, best = self.kinds[residual], None
            for kind, numbers in kinds.items():
                if kind[0] >> source & 1 or kind[1] & bit:
                    continue
                for i, number in enumerate(numbers):
                    if best is not None and number > best[0]:
                        break
                    if cluster not in bins[number].rare:
                        best = number, kind, i
                        break
            if best:
                number, kind, i = best
                del kinds[kind][i]
                if not kinds[kind]:
                    del kinds[kind]
                    if not kinds:
                        del self.kinds[residual], self.residuals[at]
                return residual, bins[number]
        return None


def pack(lengths: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> list[tuple[int, int, int, int, int, int]]:
    """(item, piece, start, length, bin, place in the bin) of items in the order given among
    equals; ``sources`` are small numbers, ``clusters`` any."""
    out, made = [], 0
    room, bins = Room(), {}
    frequent = {c: 1 << i for i, c in enumerate(c for c, n in Counter(clusters).items() if n >= FREQUENT)}
    for item in sorted(range(len(lengths)), key=lambda i: (-(lengths[i] % capacity), i)):
        whole, rest = divmod(lengths[item], capacity)
        for piece in range(whole):
            out.append((item, piece, piece * capacity, capacity, made, 0))
            made += 1
        if not rest:
            continue
        source, cluster = sources[item], clusters[item]
        bit = frequent.get(cluster, 0)
        found = room.take(rest, source, bit, cluster, bins)
        if found:
            residual, own = found
        else:
            residual, own = capacity, Bin(made)
            bins[made] = own
            made += 1
        out.append((item, whole, whole * capacity, rest, own.number, own.used))
        own.used += rest
        own.frequent |= bit
        if not bit:
            own.rare.add(cluster)
        own.counts[source] = own.counts.get(source, 0) + 1
        if own.counts[source] >= per_source:
            own.full |= 1 << source
        if residual > rest:
            room.add(residual - rest, own)
        else:
            del bins[own.number]
    return out


def measured(text: bytes) -> tuple[int, int]:
    """The number of words and a hash of them in lower case. Words take many times the bytes of their
    text, so a long text goes in slices, each up to a space."""
    n, digest, at = 0, xxhash.xxh3_64(), 0
    while at < len(text):
        space = _SPACE.search(text, at + SLICE)
        end = space.start() if space else len(text)
        words = text[at:end].lower().split()
        if words:
            digest.update(b" " * bool(n) + b" ".join(words))
        n, at = n + len(words), end
    return n, digest.intdigest() >> 1


def best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = 4096, per_source: int = 4, cluster_col: str | None = None) -> DataFrame:
    """One row for each piece: id, piece, start (in the document), n_tokens, bin, place (in the bin)."""
    spark = docs.sparkSession
    importable(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"), (F.xxhash64(cluster_col) if cluster_col else F.lit(None).cast("long")).alias("given"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in small(batches):
            lengths, equal = zip(*map(measured, raw(batch.column(2))))
            clusters = batch.column(3) if cluster_col else pa.array(equal, pa.int64())
            numbers = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n + 1 for n in lengths], pa.int64()), clusters, numbers], names=["id", "source", "n", "cluster", "row"])

    # The row numbers are written down with the lengths: a task that runs again deals the same way.
    light = written(rows.mapInArrow(measure, f"id {kind}, source string, n long, cluster long, row long"), "lengths")
    shards = max(1, -(-light.count() // SHARD))
    dealt = light.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).select("shard", "id", "source", "n", "cluster", "row")
    dealt = dealt.repartition(min(shards, shuffle_parts(spark)), "shard").sortWithinPartitions("shard", "id", "cluster", "source", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            shard = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi > lo:
                    if now is not None and shard[lo] != now and held:
                        yield packed(int(now), held)
                        held = []
                    now = shard[lo]
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield packed(int(now), held)

    def packed(shard: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches).combine_chunks()
        names: dict[str | None, int] = {}
        sources = [names.setdefault(s, len(names)) for s in t.column(2).to_pylist()]  # numbers are the bits of the bitmaps
        found = pack(t.column(3).to_pylist(), sources, t.column(4).to_pylist(), capacity, per_source)
        item, piece, start, length, number, place = (np.array(c, np.int64) for c in zip(*found))
        ids = t.column(1).combine_chunks().take(pa.array(item))
        return pa.RecordBatch.from_arrays([ids, pa.array(piece), pa.array(start), pa.array(length), pa.array((shard << 32) + number), pa.array(place)], names=["id", "piece", "start", "n_tokens", "bin", "place"])

    return dealt.mapInArrow(run, f"id {kind}, piece long, start long, n_tokens long, bin long, place long").withColumnRenamed("id", id_col)


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(documents(spark, sf_dir))
