"""Removal of repeated byte strings, by suffix sorting of those parts that can repeat.

Windows of ``length`` bytes are told apart in two steps. First each points at its anchor
(``planwright.llm.anchors``), and anchors are counted over the corpus: a window whose anchor occurs
once occurs once; all windows of two equal segments occur twice. What is left are segments that
share an anchor but differ - borders of passages, near copies. One of each kind goes, with the
others of its anchor, to a shard, and shards are suffix-sorted by external induction
(``planwright.llm.suffix_sort``): a window repeats if it shares ``length`` bytes with a neighbour.
An anchor with more segments than a shard takes is split by the bytes around it first.

Defined results: null counts as empty; a text shorter than ``length`` loses nothing; rows that
repeat id and text are copies of each other and lose what they share, all of it; an empty table
gives an empty result; bytes that remain need not be valid UTF-8; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwright.llm.anchors import anchors, gram_place
from planwright.llm.common import documents, importable, shuffle_parts, written
from planwright.llm.exact_dedup import screened
from planwright.llm.suffix_sort import repeated_starts
from planwright.llm.tokens import mix, raw, small

#: Bytes of an anchor; bytes of a shard, about; memory of a sort before it goes to disk.
GRAM, SHARD_BYTES, MEMORY = 64, 3 << 20, 256 << 20


def anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """``texts`` (k, q, text) -> g, seg, k, q, a (first window), n (windows), c: a row for each anchor.

    Segments that meet in one batch already repeat: each of their rows says so (c = 0: a finding,
    under a key that only spreads it), and a single row goes on for them all (c = 2), so a text
    that a third of the rows copy sends one row for each batch. A segment that is alone has c = 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[np.ndarray]] = [[], [], [], [], []]
            at = 0
            for part in small([batch]):
                text, g, seg, a, b = anchors(raw(part.column(2)), length, GRAM)
                for c, v in zip(found, (g, seg, text + at, a, b - a + 1)):
                    c.append(v)
                at += part.num_rows
            g, seg, text, a, n = (np.concatenate(c) for c in found)
            if not len(g):
                continue
            k, q = batch.column(0).to_numpy()[text], batch.column(1).to_numpy()[text]
            order = np.lexsort((seg, g))
            g, seg, k, q, a, n = g[order], seg[order], k[order], q[order], a[order], n[order]
            new = np.r_[True, (g[1:] != g[:-1]) | (seg[1:] != seg[:-1])]
            many = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
            local = np.flatnonzero(many)
            own = np.flatnonzero(new)
            spread = mix(k[local].view(np.uint64) + a[local].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            pick = np.r_[own, local]
            kind = np.r_[np.where(many[own], 2, 1), np.zeros(len(local), np.int64)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[g[own], spread].view(np.int64)), pa.array(seg[pick].view(np.int64)), pa.array(k[pick]), pa.array(q[pick]), pa.array(a[pick].astype(np.int64)), pa.array(n[pick].astype(np.int32)), pa.array(kind)], names=["g", "seg", "k", "q", "a", "n", "c"])

    return texts.mapInArrow(run, "g long, seg long, k long, q int, a long, n int, c int")


def judged(rows: DataFrame) -> DataFrame:
    """What the anchors decide: g, k, q, a, n, and kind - 0: all windows repeat; 1: to be sorted, alone
    in its segment; 2: to be sorted, for the others to meet. Rows that no other one meets go."""
    spark = rows.sparkSession
    keyed = rows.repartition(shuffle_parts(spark), "g").sortWithinPartitions("g", "seg")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(0).to_numpy()
            # All but the last anchor of the batch are complete.
            cut = int(np.flatnonzero(g != g[-1])[-1]) + 1 if g[0] != g[-1] else 0
            if cut:
                yield judge([*held, batch.slice(0, cut)])
                held = []
            elif held and held[-1].column(0)[0] != batch.column(0)[0]:
                yield judge(held)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield judge(held)

    def judge(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches)
        g, seg, k, q, a, n, c = (t.column(i).to_numpy() for i in range(7))
        local = np.flatnonzero(c == 0)
        own = np.flatnonzero(c > 0)
        og, oseg, oc = g[own], seg[own], c[own]
        new_g = np.r_[True, og[1:] != og[:-1]][: len(own)]
        new_s = new_g | np.r_[True, oseg[1:] != oseg[:-1]][: len(own)]
        of_s, of_g = np.cumsum(new_s) - 1, np.cumsum(new_g) - 1
        many = np.bincount(of_s, oc)[of_s] > 1
        mixed = np.bincount(of_g, new_s)[of_g] > 1
        picks = local, own[many & (oc == 1)], own[mixed & ~many], own[mixed & many & new_s]
        kind = np.repeat(np.array([0, 0, 1, 2], np.int32), [len(p) for p in picks])
        pick = np.concatenate(picks)
        return pa.RecordBatch.from_arrays([pa.array(g[pick]), pa.array(k[pick]), pa.array(q[pick]), pa.array(a[pick]), pa.array(n[pick]), pa.array(kind)], names=["g", "k", "q", "a", "n", "kind"])

    return keyed.mapInArrow(run, "g long, k long, q int, a long, n int, kind int")


_PIECE = "key long, k long, q int, a long, kind int, place int, low int, high int, part binary"


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (key, k, q, a, kind, place, low, high, part): of a text the bytes from a on, with windows
    that begin ``low`` .. ``high - 1`` bytes before their anchor, which is at ``place``."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    cols = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["key", "k", "q", "a", "kind", "place", "low", "high", "part"])


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def halves(a: int, place: int, low: int, high: int, part: bytes, length: int) -> list[tuple[int, int, int, int, int, bytes]]:
    """A piece in two, by how far its windows begin before the anchor: (key, a, place, low, high, part).
    Equal windows begin equally far, and all windows of a half share the bytes that the key is of."""
    out, n, middle = [], len(part) - length + 1, (low + high) // 2
    for x, y in ((low, middle), (middle, high)):
        first, last = max(0, place - y + 1), min(n - 1, place - x)  # places where its windows begin
        if x < y and first <= last:
            key = xxhash.xxh3_64_intdigest(part[place - x : place - y + 1 + length], seed=x * 65_536 + y)
            out.append((_signed(key), a + first, place - first, x, y, part[first : last + length]))
    return out


def sorted_rows(parts: DataFrame, texts: DataFrame, length: int, shards: int) -> DataFrame:
    """``parts`` (g, k, q, a, n, kind 1 or 2) -> k, q, a, n: windows of lone segments that repeat.

    An anchor whose segments are more than a shard is split by halves of its windows, again and
    again, until what is under one key fits or is one window; what is alone under its key goes."""
    spark = parts.sparkSession
    large = written(parts.groupBy("g").agg(F.sum(F.col("n") + F.lit(length)).alias("b")).filter(F.col("b") > SHARD_BYTES).select("g", F.lit(True).alias("large")), "large")
    by_text = parts.join(large, "g", "left").groupBy("k", "q").agg(F.collect_set(F.struct("g", "a", "n", "kind", F.coalesce("large", F.lit(False)).alias("large"))).alias("parts"))
    digest = F.concat(_key("k"), _key("q"))
    by_text = by_text.withColumn("digest", digest)
    own = screened(texts.withColumn("digest", digest), by_text.select("digest"))
    own = own.dropDuplicates(["k", "q"]).drop("digest").join(by_text.drop("digest").hint("merge"), ["k", "q"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in small(batches):
            for k, q, text, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)), batch.column(3).to_pylist()):
                for p in some:
                    part = text[p["a"] : p["a"] + p["n"] + length - 1]
                    if not p["large"]:
                        rows.append((p["g"], k, q, p["a"], p["kind"], -1, 0, 0, part))
                        continue
                    place = gram_place(part, p["g"], p["n"], length, GRAM)
                    rows += [(key, k, q, a, p["kind"], *rest) for key, a, *rest in halves(p["a"], place, 0, length - GRAM + 1, part, length)]
                if len(rows) > 4000:
                    yield _pieces(rows)
                    rows = []
        if rows:
            yield _pieces(rows)

    pieces = own.select("k", "q", "text", "parts").mapInArrow(cut, _PIECE)
    if large.isEmpty():
        return _sorted(pieces, length, shards)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield _pieces([(key, k, q, a, kind, *rest) for _, k, q, begin, kind, place, low, high, part in zip(*(c.to_pylist() for c in batch.columns)) for key, a, *rest in halves(begin, place, low, high, part, length)])

    pieces = written(pieces, "pieces")
    ready, open_ = pieces.filter("place < 0"), pieces.filter("place >= 0")
    found = None
    while True:
        sizes = open_.groupBy("key").agg(F.count("*").alias("times"), F.sum(F.length("part")).alias("b")).filter("times > 1")
        open_ = written(open_.join(sizes, "key"), "pieces")
        one = F.col("high") - F.col("low") == 1
        ready = ready.unionByName(open_.filter(~one & (F.col("b") <= SHARD_BYTES)).select(*pieces.columns))
        same = open_.filter(one & (F.col("kind") == 1)).select("k", "q", "a", F.lit(1).alias("n"))
        found = same if found is None else found.unionByName(same)
        more = open_.filter(~one & (F.col("b") > SHARD_BYTES)).select(*pieces.columns)
        if more.isEmpty():
            return _sorted(ready, length, shards).unionByName(found)
        open_ = written(more.mapInArrow(split, _PIECE), "pieces")


def _sorted(pieces: DataFrame, length: int, shards: int) -> DataFrame:
    """k, q, a, n: windows of pieces of kind 1 that begin also elsewhere in the pieces of their shard."""
    dealt = pieces.select(F.pmod("key", F.lit(shards)).alias("shard"), "k", "q", "a", "kind", "part")
    dealt = dealt.repartition(max(1, min(shards, 4 * shuffle_parts(pieces.sparkSession))), "shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shard = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi > lo:
                    if held and held[-1].column(0)[0].as_py() != shard[lo]:
                        yield sort(held)
                        held = []
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield sort(held)

    def sort(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches)
        k, q, a, kind = (t.column(i).to_numpy() for i in (1, 2, 3, 4))
        out: list[list[np.ndarray]] = [[], [], [], []]
        for i, starts in enumerate(repeated_starts(t.column(5).to_pylist(), length, MEMORY)):
            if kind[i] == 1 and len(starts):
                first = np.flatnonzero(np.r_[True, np.diff(starts) > 1])
                sizes = np.diff(np.r_[first, len(starts)])
                for c, v in zip(out, (np.full(len(first), k[i]), np.full(len(first), q[i]), a[i] + starts[first], sizes)):
                    c.append(v)
        cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(cols, kinds)], names=["k", "q", "a", "n"])

    return dealt.mapInArrow(run, "k long, q int, a long, n int")


def _key(c: str):
    return F.unhex(F.lpad(F.hex(F.col(c).cast("long")), 16, "0"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """For each row: id, n_bytes, n_removed, n_spans, kept (the bytes that remain), kept_sha256."""
    importable(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # A row is known by 96 bits of its id and text.
    own = own.withColumns({"k": F.xxhash64("id", "text"), "q": F.hash(F.lit(0x5BD1E995), "text", "id")})
    texts = own.select("k", "q", "text")
    found = written(judged(anchor_rows(texts, length)), "anchors")
    parts = found.filter("kind > 0")
    total = parts.agg(F.sum(F.col("n") + F.lit(length)).alias("b")).first()["b"] or 0
    ranges = found.filter("kind = 0").select("k", "q", "a", "n")
    if total:
        ranges = ranges.unionByName(sorted_rows(parts, texts, length, max(1, -(-total // SHARD_BYTES))))
    # A set: rows that repeat id and text name the same ranges, and they meet in the map side.
    ranges = ranges.groupBy("k", "q").agg(F.collect_set(F.struct("a", "n")).alias("ranges"))
    joined = own.join(ranges.hint("merge"), ["k", "q"], "left").select("id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            lists = batch.column(2)
            for i, text in enumerate(raw(batch.column(1))):
                removed = spans = 0
                kept = text
                if lists[i].is_valid:
                    own = lists[i].values
                    a = own.field("a").to_numpy()
                    b = a + own.field("n").to_numpy() + length - 1
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    new = np.r_[True, a[1:] > b[:-1]]
                    begin, end = a[new], b[np.r_[np.flatnonzero(new)[1:] - 1, len(b) - 1]]
                    removed, spans = int((end - begin).sum()), len(begin)
                    kept = b"".join([text[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(text)])])
                rows.append((len(text), removed, spans, kept, sha256(kept).hexdigest()))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())))], names=["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return joined.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string").withColumnRenamed("id", id_col)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir)).drop("kept")
