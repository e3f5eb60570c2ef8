"""Substring deduplication by sliding spans of sentences.

A text is cut into sentences (at line ends and after closing punctuation), and where ``WINDOW``
places between words in a row have no such end, at the one of them whose next word has the smallest
hash. So a piece has at most ``LONGEST`` words, and whether a place is cut depends on the words up to
``WINDOW`` places around it only: in a passage that two texts share the pieces are the same again
from there on, wherever it begins. In scripts without spaces a character counts as a word. From
every piece a span runs on until it has at least ``min_units`` pieces and ``min_words`` words; with
25 words, a shared run of 51 has one for certain. Spans are joined over the whole corpus by the hash
of their words (96 bits; A-Z count as a-z, white space does not count); the first of equal spans, by
id, text and then place, stays, and every piece that any other of them covers is removed, with the
white space after it.

Defined results: null text stays null and counts no sentence; a text without any span long enough
loses nothing; a null id comes first; rows that repeat both id and text share one decision and do
not count as repeats of each other; rows that share an id but not the text are told apart by the
text; an empty table gives an empty result; all columns are kept, and a result column whose name
the input has already gets an underscore behind it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from planwright.llm.common import documents, free_names, importable, written
from planwright.llm.tokens import mix, raw, small

#: Words that no piece exceeds.
LONGEST = 20
#: Places of which one is a cut: shared runs of 25 + 4 * WINDOW - 2 words have a span in common.
WINDOW = 7
_UNSPACED = "฀-໿က-႟ក-៿々-〇぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff"
_SPACES = " \t-\r"
_WORD = re.compile(rf"(?:[^{_SPACES}{_UNSPACED}。！？]+[。！？]?|[{_UNSPACED}。！？])[{_SPACES}]*")
_R1, _R2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _table(*values: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_SPACE, _BLANK, _CLOSING = _table(32, *range(9, 14)), _table(32, 9), _table(*b".!?")
#: First bytes of characters of scripts without spaces, and of their punctuation.
_FAR = _table(0xE0, 0xE1, *range(0xE3, 0xEA), 0xEF, 0xF0)
_power: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """1, base, base ** 2, ... modulo 2 ** 64; kept for the next texts."""
    if len(_power.get(base, ())) < n:
        out = np.full(max(n, 1 << 18), base, np.uint64)
        out[0] = 1
        _power[base] = np.multiply.accumulate(out)
    return _power[base]


@dataclass
class Pieces:
    """The pieces of some texts that follow each other in ``data``. A piece runs from the word
    ``word[i]`` to the word ``word[i + 1]``; text t has the pieces ``first[t]`` .. ``first[t + 1] - 1``."""

    data: bytes
    text: np.ndarray  # where each text begins in data, and where the last ends
    at: np.ndarray  # where each piece begins in data (the first of a text: where the text does)
    word: np.ndarray
    first: np.ndarray
    hashes: np.ndarray  # of the words

    def spans(self, min_units: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, h1, h2): spans cover the pieces from .. to - 1."""
        n, words = len(self.at), len(self.hashes)
        start = np.arange(n)
        end = np.maximum(np.searchsorted(self.word, self.word[:-1] + min_words), start + min_units)
        inside = end <= np.repeat(self.first[1:], np.diff(self.first))
        start, end = start[inside], end[inside]
        a, b = self.word[start], self.word[end]
        out = []
        for base, h in ((_R1, self.hashes), (_R2, mix(self.hashes))):  # spans of equal words have equal sums, wherever they are
            sums = np.zeros(words + 1, np.uint64)
            np.cumsum(h * _powers(words + 1, base)[:words], out=sums[1:])
            own = (sums[b] - sums[a]) * _powers(words + 1, pow(base, -1, 1 << 64))[a]
            out.append(mix(own + (b - a).astype(np.uint64)))
        return start, end, out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _spaced(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that put spaces between words: where words begin, their hashes, and before which of
    them a sentence ends."""
    x = np.frombuffer(data, np.uint8)
    space = _SPACE[x]
    starts = np.flatnonzero(np.diff(space, prepend=True) & ~space)
    hashes = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, data.lower().split())), np.uint64)
    ends = np.flatnonzero((x[:-1] == 10) | (_CLOSING[x[:-1]] & _BLANK[x[1:]])) if len(x) else starts
    cut = np.zeros(len(starts) + 1, bool)
    cut[np.searchsorted(starts, ends, "right")] = True
    return starts, hashes, cut[:-1]


def _unspaced(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of a text in a script that does not."""
    text = data.decode("utf-8", "surrogateescape")
    words = [m.group() for m in _WORD.finditer(text)]
    sizes = np.array([0, *(len(w.encode("utf-8", "surrogateescape")) for w in words)], np.int64)
    lead = len(data) - len(data.lstrip(b" \t\n\x0b\x0c\r"))
    bare = [w.strip(" \t\n\x0b\x0c\r").encode("utf-8", "surrogateescape").lower() for w in words]
    hashes = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, bare)), np.uint64)
    ends = [False, *(("\n" in w) or b[-3:].decode("utf-8", "replace")[-1:] in "。！？" or (b[-1:] in b".!?" and w[-1] in " \t") for w, b in zip(words, bare))]
    return (np.cumsum(sizes)[:-1] + lead)[: len(words)], hashes, np.array(ends[: len(words)], bool)


def pieces(texts: list[bytes]) -> Pieces:
    """All texts at once: what is done for each word is done in one go."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    text = np.concatenate([[0], np.cumsum(sizes + 1)])  # a line end parts them
    data = b"\n".join([*texts, b""])
    far = [i for i, t in enumerate(texts) if not t.isascii() and _FAR[np.frombuffer(t, np.uint8)].any()]
    parts, done = [], 0
    for i in [*far, len(texts)]:
        if i > done:
            parts.append((text[done], _spaced(data[text[done] : text[i]])))
        if i < len(texts):
            parts.append((text[i], _unspaced(texts[i])))
        done = i + 1
    if not parts:
        parts = [(0, _spaced(b""))]
    at = np.concatenate([p[0] + begin for begin, p in parts])
    hashes = np.concatenate([p[1] for _, p in parts])
    cut = np.concatenate([p[2] for _, p in parts])
    n = len(at)
    head = np.searchsorted(at, text)  # first word of each text
    cut[head[:-1][head[:-1] < n]] = True
    if n > WINDOW:  # a window across two texts holds the first place of the second, which is cut
        key = np.where(cut, np.uint64(0), hashes)[1:]
        cut[sliding_window_view(key, WINDOW).argmin(1) + np.arange(1, n - WINDOW + 1)] = True
    word = np.flatnonzero(cut)
    first = np.searchsorted(word, head)
    begin = at[word]
    some = np.diff(first) > 0
    begin[first[:-1][some]] = text[:-1][some]
    return Pieces(data, text, begin, np.append(word, n), first, hashes)


def units(text: str) -> tuple[list[str], np.ndarray]:
    """Pieces of one text (joined they give the text) and the words of each."""
    p = pieces([text.encode("utf-8", "surrogateescape")])
    places = [*p.at.tolist(), int(p.text[1]) - 1]
    return [p.data[a:b].decode("utf-8", "surrogateescape") for a, b in zip(places, places[1:])], np.diff(p.word)


def span_rows(docs: DataFrame, min_units: int, min_words: int) -> DataFrame:
    """``docs`` (id, th, text) -> one row for each span: h1, h2, id, th, pos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            p = pieces(raw(batch.column(2)))
            start, _, h1, h2 = p.spans(min_units, min_words)
            if len(start):
                owner = np.repeat(np.arange(batch.num_rows), np.diff(p.first))[start]
                of = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), batch.column(0).take(of), batch.column(1).take(of), pa.array((start - p.first[owner]).astype(np.int32))], names=["h1", "h2", "id", "th", "pos"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"h1 long, h2 int, id {kind}, th int, pos int")


def span_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_units: int = 2, min_words: int = 25) -> DataFrame:
    """``docs`` with all columns, the text rid of repeated spans, and n_units, n_removed."""
    importable(docs.sparkSession)
    n = len(docs.columns)
    own = docs.toDF(*[f"c{j}" for j in range(n)])
    ident, at = f"c{docs.columns.index(id_col)}", docs.columns.index(text_col)
    # Rows that share an id are told apart by their text; a few bits do, as what is lost has its own hash.
    own = own.withColumn("th", F.crc32(F.col(f"c{at}").cast("binary")).bitwiseAND(0x7FFFFFFF).cast("int"))
    rows = written(span_rows(own.select(F.col(ident).alias("id"), "th", F.col(f"c{at}").alias("text")), min_units, min_words), "spans")
    # The hashes alone tell most spans to be single; places are compared among the others only.
    again = written(rows.groupBy("h1").count().filter("count > 1").select("h1"), "again")
    # One number for text and place: it has their order, and rows move narrower.
    place = (F.shiftleft(F.col("th").cast("long"), 32) + F.col("pos")).alias("place")
    rows = written(rows.select("h1", "h2", "id", place).join(again.hint("merge"), "h1").select("h1", "h2", "id", "place"), "again-spans")
    place = F.struct("id", "place")
    first = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    first = written(first.filter("n > 1").select("h1", "h2", "first"), "repeats")
    later = rows.join(first.hint("merge"), ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    # A set: rows that repeat id and text name the same places, and they meet in the map side.
    pos = F.col("place").bitwiseAND(0xFFFFFFFF).cast("int").alias("pos")
    lost = later.groupBy("id", F.shiftright("place", 32).cast("int").alias("of")).agg(F.collect_set(F.struct(pos, "h1")).alias("lost"))
    plain = own.join(lost.hint("merge"), F.col(ident).eqNullSafe(F.col("id")) & F.col("th").eqNullSafe(F.col("of")), "left").drop("id", "th", "of")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = raw(batch.column(at))
            p = pieces(texts)
            gone = np.zeros(len(texts), np.int64)
            lists = batch.column(n)
            if lists.null_count < len(lists):
                start, end, h1, _ = p.spans(min_units, min_words)
                owner = np.repeat(np.arange(len(texts)), np.diff(p.first))
                named = lists.flatten()
                of = np.repeat(np.arange(len(texts)), lists.value_lengths().fill_null(0).to_numpy())
                wanted = p.first[of] + named.field("pos").to_numpy()
                inside = wanted < p.first[of + 1]
                # The span from each piece, if there is one, must have the hash that was named.
                by_piece = np.full(len(p.at) + 1, -1)
                by_piece[start] = np.arange(len(start))
                span = np.where(inside, by_piece[np.minimum(wanted, len(p.at))], -1)
                ok = span >= 0
                ok[ok] = h1[span[ok]] == named.field("h1").to_numpy()[ok]
                drop = np.zeros(len(p.at) + 1, np.int64)
                np.add.at(drop, start[span[ok]], 1)
                np.add.at(drop, end[span[ok]], -1)
                dead = np.cumsum(drop)[:-1] > 0
                np.add.at(gone, owner[dead], 1)
                for i in np.flatnonzero(gone).tolist():
                    lo, hi = p.first[i], p.first[i + 1]
                    places = [*p.at[lo:hi].tolist(), int(p.text[i + 1]) - 1]
                    texts[i] = b"".join([p.data[a:b] for a, b, d in zip(places, places[1:], dead[lo:hi].tolist()) if not d])
            column = batch.column(at)
            if gone.any():
                column = pa.array([t if v else None for t, v in zip(texts, column.is_valid().to_pylist())], pa.binary()).cast(column.type, safe=False)
            cols = [column if j == at else batch.column(j) for j in range(n)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(p.first)), pa.array(gone)], names=[f"c{j}" for j in range(n + 2)])

    kinds = [*[f.dataType for f in docs.schema], LongType(), LongType()]
    out = plain.mapInArrow(cut, StructType([StructField(f"c{j}", k) for j, k in enumerate(kinds)]))
    return out.toDF(*docs.columns, *free_names(docs, "n_units", "n_removed"))


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = span_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("n_units").alias("n_sentences"), "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
