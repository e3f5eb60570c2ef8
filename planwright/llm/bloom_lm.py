"""Language-model scoring with a log-frequency Bloom filter.

Counts of word pairs and triples are quantised on a logarithmic scale, and an n-gram of level q is put
in the filter as (n-gram, 1) .. (n-gram, q); its level is read back by probing 1, 2, ... until one is
missing. A text is scored by hierarchical Dirichlet smoothing, from single words up:

    P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))
    P(w | v) = (c(vw) + mu P(w)) / (c(v) + mu)
    P(w | u v) = (c(uvw) + nu P(w | v)) / (c(uv) + nu)

Counts of words are exact. Of an n-gram the filter knows a range: its least count stands above the
line and, where a pair is the context, its largest below, so that the probabilities of all words
after a context sum to no more than 1 (but for false positives of the filter, about one in 40).

The filter is cut into segments by the code of the n-gram, more of them the larger the corpus, and is
never in one place. Texts are gathered in chunks; a chunk sends the sorted codes of its n-grams and
words, with their counts in training texts, to the segments they lie in as one run of bytes each. A
segment adds them up, fills a filter as large as its own n-grams need, probes it, and answers each chunk
with a level an n-gram and a count a word; the chunk's tokens meet these answers in a second exchange.

Defined results: null text counts as empty and has its end as the only token; no training row at
all gives N = V = 0; repeated rows are scored each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planwright.llm.common import documents, importable, set_for, shuffle_parts, written
from planwright.llm.tokens import mix, raw, small, word_hashes

START, END = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC3A5C85C97CB3127)
_PAIR, _TRIPLE, _LEVEL = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
HASHES, BASE = 4, 1.5
#: Bits of the filter for an item, at least.
ITEM_BITS = 8
#: Tokens of a chunk (a longer text is one by itself), and bytes of text for each segment.
GATHER, SEGMENT_TEXT = 1 << 18, 1 << 22
#: Segments at least, as soon as there is text for them: what a chunk sends to one stays small.
FEWEST = 1 << 10
#: A chunk is a row of a megabyte or two: few of them are read at a time.
_WIDE = {"spark.sql.parquet.columnarReaderBatchSize": "4"}
#: Bits of an n-gram's code beyond those that number the bytes of the corpus. A token of prose has some
#: six bytes and two n-grams, so fewer than one in 90 meets another one's code: less than the filter's
#: own false positives.
SPARE = 5


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def level_range(level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest count that a level stands for; 0 for 0."""
    low, high = np.ceil(BASE ** (level - 1.0) - 1e-9), np.ceil(BASE ** (level + 0.0) - 1e-9) - 1
    return np.where(level > 0, low, 0.0), np.where(level > 0, np.maximum(low, high), 0.0)


def ngram_codes(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word the codes of (word before it, word) and (two words before it, word); the first
    of a text follows START and has no triple: it repeats the pair."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[starts] = START
    pairs = mix(before * _PAIR + words)
    triples = pairs.copy()
    inner = np.ones(len(words), bool)
    inner[starts] = False
    inner = np.flatnonzero(inner)
    triples[inner] = mix(pairs[inner - 1] * _TRIPLE + words[inner])
    return pairs, triples


@dataclass
class LogBloom:
    """A bit field, a power of two bits long."""

    bits: np.ndarray  # uint8

    @classmethod
    def of(cls, codes: np.ndarray, counts: np.ndarray) -> "LogBloom":
        """The filter of distinct ``codes``, as large as their items need: none is left out."""
        times = levels(counts)
        items = int(times.sum()) if len(codes) else 0
        out = cls(np.zeros(max(8, (1 << max(6, (items * ITEM_BITS - 1).bit_length())) // 8), np.uint8))
        for j in range(1, int(times.max()) + 1 if len(codes) else 1):
            for at in out._probes(codes[times >= j], j):
                np.bitwise_or.at(out.bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        return out

    def _probes(self, codes: np.ndarray, j: int) -> Iterator[np.ndarray]:
        h = mix(codes + np.uint64(j * int(_LEVEL) % (1 << 64)))
        step = (h >> np.uint64(32)) | np.uint64(1)
        for i in range(HASHES):
            yield ((h + np.uint64(i) * step) & np.uint64(len(self.bits) * 8 - 1)).astype(np.int64)

    def level(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes), np.int64)
        alive, j = np.arange(len(codes)), 1
        while len(alive):
            hit = np.ones(len(alive), bool)
            for at in self._probes(codes[alive], j):
                hit &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            alive = alive[hit]
            out[alive] = j
            j += 1
        return out


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first: the empty high bytes compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unplaned(b: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _packed(x: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return _planes(np.diff(x, prepend=np.zeros(1, np.uint64)))


def _unpacked(b: bytes) -> np.ndarray:
    return np.cumsum(_unplaned(b, np.uint64), dtype=np.uint64)


def _segment(codes: np.ndarray, below: int) -> np.ndarray:
    return codes >> np.uint64(below) if below < 64 else np.zeros(len(codes), np.uint64)


def _told(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.Table]:
    """Rows of batches in groups of equal values in column ``by``, by which they are sorted. (Slices:
    nothing is copied before its group is at hand.)"""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(by).to_numpy()
        ends = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for a, b in zip(ends, ends[1:]):
            if held and a < b and held[0].column(by)[0].as_py() != key[a]:
                yield pa.Table.from_batches(held)
                held = []
            if a < b:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _chunks(rows: DataFrame) -> DataFrame:
    """``rows`` (id, text, held_out) -> a row for each chunk: its distinct words in order, each
    token's place among them, and tokens, id and held_out of each text."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, n, ids, out, held = TaskContext.get().partitionId() << 32, 0, [], [], []
        for batch in small(batches):
            begin = 0
            for i, text in enumerate(raw(batch.column(1))):
                held.append(np.append(word_hashes(text), END))
                n += len(held[-1])
                if n >= GATHER:
                    ids.append(batch.column(0).slice(begin, i + 1 - begin))
                    out.append(batch.column(2).slice(begin, i + 1 - begin))
                    yield from sent(chunk, pa.concat_arrays(ids), pa.concat_arrays(out), held)
                    chunk, n, ids, out, held, begin = chunk + 1, 0, [], [], [], i + 1
            if begin < batch.num_rows:
                ids.append(batch.column(0).slice(begin))
                out.append(batch.column(2).slice(begin))
        if held:
            yield from sent(chunk, pa.concat_arrays(ids), pa.concat_arrays(out), held)

    def sent(chunk: int, ids: pa.Array, held_out: pa.Array, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(h) for h in held])
        words, at = np.unique(np.concatenate(held), return_inverse=True)
        one = lambda b: pa.array([b], pa.binary())
        some = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        yield pa.RecordBatch.from_arrays([pa.array([chunk]), one(_packed(words)), one(_planes(at.astype(np.int32))), one(_planes(sizes)), some(ids), some(held_out)], names=["chunk", "words", "at", "sizes", "ids", "held_out"])

    return rows.select("id", "text", "held_out").mapInArrow(run, f"chunk long, words binary, at binary, sizes binary, ids array<{kind}>, held_out array<boolean>")


def _ngrams(words: np.ndarray, at: np.ndarray, sizes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, of so many bits, of a chunk's pairs and triples, in order; and of each token
    the places of its pair and its triple among them (2 rows)."""
    both = np.concatenate(ngram_codes(words[at], np.cumsum(sizes) - sizes)) >> np.uint64(64 - bits)
    codes, of = np.unique(both, return_inverse=True)
    return codes, of.reshape(2, -1)


def _asked(chunks: DataFrame, segment_bits: int, bits: int) -> DataFrame:
    """For each chunk and segment the codes of n-grams and the words that lie in it, each with its
    count in training texts; no row where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, packed, at, sizes, held_out = (batch.column(j)[i] for j in range(5))
                words, at, sizes = _unpacked(packed.as_py()), _unplaned(at.as_py(), np.int32), _unplaned(sizes.as_py(), np.int64)
                learnt = np.repeat(~held_out.values.fill_null(True).to_numpy(zero_copy_only=False).astype(bool), sizes)
                seen = np.bincount(at, weights=learnt, minlength=len(words)).astype(np.int64)
                codes, of = _ngrams(words, at, sizes, bits)
                first = np.cumsum(sizes) - sizes
                times = np.bincount(of[0], weights=learnt, minlength=len(codes))
                learnt[first] = False  # where there is no triple
                times += np.bincount(of[1], weights=learnt, minlength=len(codes))
                times = times.astype(np.int64)
                own, others = _segment(codes, bits - segment_bits), _segment(words, 64 - segment_bits)
                some = np.union1d(own, others)
                p, q = np.append(np.searchsorted(own, some), len(own)), np.append(np.searchsorted(others, some), len(others))
                cut = lambda x, ends: pa.array([_packed(x[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())  # noqa: B023, E731
                counts = pa.array([_planes(np.append(times[a:b], seen[c:d])) for a, b, c, d in zip(p, p[1:], q, q[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), chunk.as_py())), pa.array(some.astype(np.int64)), cut(codes, p), cut(words, q), counts], names=["chunk", "segment", "codes", "words", "counts"])

    return chunks.select("chunk", "words", "at", "sizes", "held_out").mapInArrow(run, "chunk long, segment long, codes binary, words binary, counts binary")


def _answers(asked: DataFrame) -> DataFrame:
    """Of each chunk and segment the levels of its n-grams and the counts of its words, in their
    order; and one row a segment (chunk null) with the segment's share of N, V and of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _told(batches, 1):
            codes, words = ([_unpacked(x.as_py()) for x in rows.column(c)] for c in ("codes", "words"))
            counts = [_unplaned(x.as_py(), np.int64) for x in rows.column("counts")]
            pairs, at = np.unique(np.concatenate(codes), return_inverse=True)
            times = np.bincount(at, weights=np.concatenate([c[: len(x)] for c, x in zip(counts, codes)]), minlength=len(pairs)).astype(np.int64)
            bloom = LogBloom.of(pairs[times > 0], times[times > 0])
            level = bloom.level(pairs).astype(np.uint8)[at]
            kinds, of = np.unique(np.concatenate(words), return_inverse=True)
            seen = np.bincount(of, weights=np.concatenate([c[len(x) :] for c, x in zip(counts, codes)]), minlength=len(kinds)).astype(np.int64)
            told = seen[of]
            i, j = np.cumsum([0, *map(len, codes)]), np.cumsum([0, *map(len, words)])
            n = rows.num_rows
            none = [None] * n
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*rows.column("chunk").to_pylist(), None], pa.int64()),
                    pa.array([rows.column("segment")[0].as_py()] * (n + 1), pa.int64()),
                    pa.array([*[level[a:b].tobytes() for a, b in zip(i, i[1:])], None], pa.binary()),
                    pa.array([*[_planes(told[a:b]) for a, b in zip(j, j[1:])], None], pa.binary()),
                    pa.array([*none, int(seen.sum())], pa.int64()),
                    pa.array([*none, int((seen > 0).sum())], pa.int64()),
                    pa.array([*none, int(seen[kinds == END].sum())], pa.int64()),
                ],
                names=["chunk", "segment", "levels", "seen", "n", "v", "texts"],
            )

    rows = asked.repartition(shuffle_parts(asked.sparkSession), "segment").sortWithinPartitions("segment")
    return rows.mapInArrow(run, "chunk long, segment long, levels binary, seen binary, n long, v long, texts long")


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", mu: float = 300.0, nu: float = 10.0) -> DataFrame:
    """For each row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    importable(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (~train).alias("held_out"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = written(_chunks(rows), "chunks")
    segment_bits = max((size // SEGMENT_TEXT).bit_length(), min(FEWEST, size >> 18).bit_length() - 1, 0)
    bits = min(64, max(32, size.bit_length() + SPARE))
    with set_for(spark, _WIDE):
        answers = written(_answers(_asked(chunks, segment_bits, bits)), "answers")
    total = answers.filter("chunk is null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "texts")]).first()
    tokens, texts = total["n"], total["texts"]
    below = tokens + 0.1 * (total["v"] + 1)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in _told(batches, 0):  # a chunk's tokens come first, then its answers by segment
            yield scored(met)

    def scored(met: pa.Table) -> pa.RecordBatch:
        own = met.slice(0, 1).to_batches()[0]
        level = np.frombuffer(b"".join(x.as_py() for x in met.column(2) if x.is_valid), np.uint8)
        count = np.concatenate([_unplaned(x.as_py(), np.int64) for x in met.column(3) if x.is_valid]).astype(np.float64)
        words = _unpacked(own.column(4)[0].as_py())
        at, sizes = _unplaned(own.column(5)[0].as_py(), np.int32), _unplaned(own.column(6)[0].as_py(), np.int64)
        starts = np.cumsum(sizes) - sizes
        codes, (pair, triple) = _ngrams(words, at, sizes, bits)
        if len(codes) != len(level) or len(words) != len(count):
            raise RuntimeError("a chunk has not got all of its answers")
        least, most = (v[level] for v in level_range(np.arange(256)))
        context = np.empty(len(at))
        context[1:] = count[at[:-1]]
        context[starts] = texts
        base = (count + 0.1) / below
        lm = (np.minimum(least[pair], context) + mu * base[at]) / (context + mu)
        inner = np.ones(len(at), bool)
        inner[starts] = False
        inner = np.flatnonzero(inner)
        context = most[pair[inner - 1]]
        lm[inner] = (np.minimum(least[triple[inner]], context) + nu * lm[inner]) / (context + nu)
        lm = np.log10(lm)
        sums = [sizes, np.add.reduceat((count > 0).astype(np.int64)[at], starts), np.add.reduceat(np.log10(base)[at], starts), np.add.reduceat(lm, starts)]
        return pa.RecordBatch.from_arrays([own.column(7).flatten(), own.column(8).flatten(), *map(pa.array, sums)], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    own, told = ("words", "at", "sizes", "ids", "held_out"), ("levels", "seen")
    asking = chunks.select("chunk", F.lit(-1).cast("long").alias("segment"), *[F.lit(None).cast("binary").alias(c) for c in told], *own)
    telling = answers.filter("chunk is not null").select("chunk", "segment", *told, *[F.lit(None).cast(chunks.schema[c].dataType).alias(c) for c in own])
    met = asking.unionByName(telling).repartition(shuffle_parts(spark), "chunk").sortWithinPartitions("chunk", "segment")
    with set_for(spark, _WIDE):
        out = written(met.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"), "scores")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), "base_score", "score")


def in_training(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(10)) != 0, F.lit(True))


def op6_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), in_training("doc_id"))
