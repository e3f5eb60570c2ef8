"""Language identification by interpolated Kneser-Ney character models, one for each language.

The models are fitted on a bounded sample of labelled rows - of each language the ``max_docs``
different texts of smallest hash, and no more of them than it takes to reach ``max_chars`` characters -
and held as sorted hash arrays that all languages share: one array of n-gram hashes for each order,
beside it a matrix with a column of log-probabilities and one of back-off weights for each language.
A text gets the language of lowest cross-entropy for each character.

A text is rejected whose cross-entropy is beyond the limit of that language. The limit comes from
labelled rows held back of the fit: it lies half way from what nearly all rows of the language stay
below to what nearly all rows of the other languages stay above.

Every text is read whole. Defined results: null text, or text without a letter, is ``und`` with
score 0 and rejected; no labelled row at all: every text is ``und``; texts of fewer than 60 letters,
and languages with fewer than 50 labelled texts, have no limit; ties go to the language that sorts
first; repeated rows are judged each and drawn once; an empty table gives an empty result; other
columns stay and are ignored by the prediction; a result column whose name the input has already
gets an underscore behind it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from planwright.llm.common import documents, free_names, importable
from planwright.llm.tokens import small

UND = "und"
#: Characters that one step of scoring takes at most; longer texts take several steps.
BLOCK = 1 << 20
#: Characters of evidence after which the score grows no surer.
EVIDENCE = 60
#: Characters that share the probability of one that was never seen.
UNSEEN = 50_000
_SPACE = 32
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

_fold: np.ndarray | None = None


def _folded() -> np.ndarray:
    """Of each code point below 65536: its lower-case letter, or a space if it is no letter."""
    global _fold
    if _fold is None:
        _fold = np.full(65536, _SPACE, np.uint16)
        for c in range(65536):
            ch = chr(c)
            if ch.isalpha():
                _fold[c] = min(ord(ch.lower()[0]), 65535)
    return _fold


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code units of all texts one after another, each text begun by a space, runs of other
    characters as one space; and where each text begins. Letters beyond the first plane are
    folded into its private area."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    raw = np.frombuffer("".join([" " + t for t in texts]).encode("utf-32-le", "replace"), np.uint32)
    units = _folded()[np.minimum(raw, 65535)]
    if len(raw) and raw.max() > 65535:
        high = np.flatnonzero(raw > 65535)
        points, back = np.unique(raw[high], return_inverse=True)
        units[high] = np.array([0xE000 + p % 0x1900 if chr(p).isalpha() else _SPACE for p in points], np.uint16)[back]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    blank = units == _SPACE
    keep = np.ones(len(units), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[starts[:-1][sizes > 0]] = True
    return units[keep], np.concatenate([[0], np.cumsum(keep)])[starts]


def grams(units: np.ndarray, n: int) -> np.ndarray:
    """The n-gram that ends at each unit, packed: exact for n up to 4."""
    out = units.astype(np.uint64)
    for k in range(1, n):
        out[k:] |= units[:-k].astype(np.uint64) << np.uint64(16 * k)
    return out


def _hash(packed: np.ndarray) -> np.ndarray:
    h = (packed ^ (packed >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def _low(packed: np.ndarray, n: int) -> np.ndarray:
    return packed & np.uint64((1 << 16 * n) - 1) if n < 4 else packed


@dataclass
class CharModels:
    langs: list[str]
    order: int
    #: For n = 1 .. order: sorted hashes, log-probabilities, log back-off weights (rows: n-grams).
    hashes: list[np.ndarray]
    logp: list[np.ndarray]
    back: list[np.ndarray]
    floor: float
    limit: np.ndarray | None = None

    @classmethod
    def fit(cls, by_lang: dict[str, list[str]], order: int = 4) -> "CharModels":
        langs = sorted(by_lang)
        counts: list[list[tuple[np.ndarray, np.ndarray]]] = []  # [order][lang]: n-grams, counts
        for n in range(1, order + 1):
            counts.append([])
            for lang in langs:
                units, starts = letters(by_lang[lang])
                place = np.arange(len(units)) - starts[:-1][np.searchsorted(starts[:-1], np.arange(len(units)), "right") - 1]
                counts[-1].append(np.unique(grams(units, n)[place >= n - 1], return_counts=True))
        for n in range(order - 1, 0, -1):  # lower orders count the kinds of characters before
            for k in range(len(langs)):
                kinds, times = np.unique(_low(counts[n][k][0], n), return_counts=True)
                first = ~np.isin(counts[n - 1][k][0], kinds)  # n-grams seen only at the start of a text
                both = np.concatenate([kinds, counts[n - 1][k][0][first]])
                sort = np.argsort(both)
                counts[n - 1][k] = both[sort], np.concatenate([times, np.ones(first.sum(), times.dtype)])[sort]
        size = max(1, len(np.unique(np.concatenate([c[0] for c in counts[0]]))) if langs else 1)
        out = cls(langs, order, [], [], [], float(-np.log(size + 1)))
        lower, lower_ids = np.full((1, len(langs)), out.floor), None
        contexts = [np.zeros((1, len(langs)))]
        all_ids = [np.unique(np.concatenate([c[0] for c in row])) if langs else np.zeros(0, np.uint64) for row in counts]
        for n in range(1, order + 1):
            ids = all_ids[n - 1]
            at_lower = np.zeros(len(ids), np.int64) if lower_ids is None else np.searchsorted(lower_ids, _low(ids, n - 1))
            own_ctx = ids >> np.uint64(16)
            at_ctx = np.zeros(len(ids), np.int64) if n == 1 else np.searchsorted(all_ids[n - 2], own_ctx)
            back = np.zeros((1 if n == 1 else len(all_ids[n - 2]), len(langs)))
            prob = np.zeros((len(ids), len(langs)))
            for k in range(len(langs)):
                seen, times = counts[n - 1][k]
                n1, n2 = (times == 1).sum(), (times == 2).sum()
                cut = min(0.95, max(0.1, n1 / max(1, n1 + 2 * n2)))
                at = np.searchsorted(ids, seen)
                total = np.bincount(at_ctx[at], times, len(back))
                kinds = np.bincount(at_ctx[at], minlength=len(back))
                weight = np.where(total > 0, cut * kinds / np.maximum(total, 1), 1.0)
                back[:, k] = np.log(weight)
                prob[:, k] = weight[at_ctx] * np.exp(lower[at_lower, k])
                prob[at, k] += np.maximum(times - cut, 0) / total[at_ctx[at]]
            contexts.append(back)
            lower, lower_ids = np.log(prob), ids
            h = _hash(ids)
            sort = np.argsort(h)
            out.hashes.append(h[sort])
            out.logp.append(lower[sort].astype(np.float32))
        for n in range(1, order):  # weights of contexts of n characters, in the order of the hashes
            out.back.append(contexts[n + 1][np.argsort(_hash(all_ids[n - 1]))].astype(np.float32))
        out.start = contexts[1][0].astype(np.float32)
        return out

    def _find(self, packed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        h, held = _hash(packed), self.hashes[n - 1]
        at = np.minimum(np.searchsorted(held, h), max(0, len(held) - 1))
        return at, held[at] == h if len(held) else np.zeros(len(h), bool)

    def look(self, packed: np.ndarray, n: int) -> np.ndarray:
        """Log-probability of the last character of each n-gram after the others, by language."""
        if n == 0:
            return np.full((len(packed), len(self.langs)), self.floor - np.log(UNSEEN), np.float32)
        at, hit = self._find(packed, n)
        out = np.empty((len(packed), len(self.langs)), np.float32)
        out[hit] = self.logp[n - 1][at[hit]]
        miss = ~hit
        if miss.any():
            rest = self.look(_low(packed[miss], n - 1) if n > 1 else packed[miss], n - 1)
            if n > 1:
                ctx, known = self._find(packed[miss] >> np.uint64(16), n - 1)
                rest[known] += self.back[n - 2][ctx[known]]
            else:
                rest = rest + self.start
            out[miss] = rest
        return out

    def entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats for each character, by text and language; number of characters that counted."""
        sums, sizes = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        group, chars = [], 0
        for i, t in enumerate([*texts, None]):
            if t is None or chars + len(t) > BLOCK:
                if group:
                    self._add([texts[j] for j in group], group, sums, sizes)
                group, chars = [], 0
            if t is not None:
                if len(t) > BLOCK:
                    step = BLOCK - 8
                    for a in range(0, len(t), step):
                        self._add([t[max(0, a - 8) : a + step]], [i], sums, sizes)
                    continue
                group.append(i)
                chars += len(t)
        return -sums / np.maximum(sizes, 1)[:, None], sizes

    def _add(self, texts: list[str], rows: list[int], sums: np.ndarray, sizes: np.ndarray) -> None:
        units, starts = letters(texts)
        n = self.order
        place = np.arange(len(units)) - np.repeat(starts[:-1], np.diff(starts))
        packed, inner = grams(units, n), place >= n - 1
        for k, sel in [(n, inner), *((m, place == m - 1) for m in range(2, n))]:  # the first characters have less before them
            own = np.flatnonzero(sel)
            if not len(own):
                continue
            codes, kinds = pd.factorize(_low(packed[own], k))
            found = self.look(kinds.astype(np.uint64), k)[codes]
            text_of = np.repeat(np.arange(len(texts)), np.diff(starts))[own]
            first = np.flatnonzero(np.r_[True, text_of[1:] != text_of[:-1]])
            at = np.array(rows)[text_of[first]]
            np.add.at(sums, at, np.add.reduceat(found.astype(np.float64), first, axis=0))
            np.add.at(sizes, at, np.diff(np.r_[first, len(own)]))

    def calibrate(self, by_lang: dict[str, list[str]], quantile: float = 0.995, least: float = 0.3, alone: float = 0.75, shortest: int = 60) -> None:
        """From rows held back of the fit: the cross-entropy beyond which a text is rejected. The
        margin above a language's own rows is half the gap to those of the others, at least
        ``least``; ``alone`` if there are no others."""
        self.limit = np.full(len(self.langs), np.inf)
        found = {}
        for lang in self.langs:
            ce, n = self.entropy(by_lang.get(lang, []))
            found[lang] = ce[n >= shortest]
        for k, lang in enumerate(self.langs):
            own = found[lang][:, k]
            others = [found[x][:, k] for x in self.langs if x != lang and len(found[x])]
            if len(own) >= 10:
                high = np.quantile(own, quantile)
                margin = max(least, (np.quantile(np.concatenate(others), 1 - quantile) - high) / 2) if others else alone
                self.limit[k] = high + margin

    def predict(self, texts: list[str | None], shortest: int = 60) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        own = [t if t else "" for t in texts]
        ce, n = self.entropy(own) if self.langs else (np.zeros((len(own), 1)), np.zeros(len(own), np.int64))
        some = np.array([any(map(str.isalpha, t)) for t in own], bool) & bool(self.langs)
        best = ce.argmin(axis=1)
        z = -(ce - ce.min(axis=1, keepdims=True)) * np.minimum(np.maximum(n, 1), EVIDENCE)[:, None]
        score = np.where(some, 1 / np.exp(z).sum(axis=1), 0.0)
        far = (ce.min(axis=1) > self.limit[best]) & (n >= shortest) if self.limit is not None and self.langs else np.zeros(len(own), bool)
        return [self.langs[b] if s else UND for b, s in zip(best, some)], score, far | ~some


def drawn(docs: DataFrame, text_col: str, lang_col: str, max_docs: int, max_chars: int) -> DataFrame:
    """(lang, h, text): the bounded sample that models are fitted on. The texts are drawn by a hash of
    their own, so copies count once, and copies collapse where they are read."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(7), "text"), 2))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not sizes:
        return rows.select("lang", "h", "text").limit(0)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, (1.3 * max_docs + 20) / max(n, 1)) * (1 << 62)))])
    some = rows.filter(F.col("h") <= share[F.col("lang")]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("h")
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return some.withColumns({"place": F.row_number().over(order), "before": before}).filter((F.col("place") <= max_docs) & (F.col("before") < max_chars)).select("lang", "h", "text")


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_docs: int = 400, max_chars: int = 4_000_000, order: int = 4) -> CharModels:
    """Models of the languages of ``docs``, from at most ``max_docs`` labelled texts of each."""
    importable(docs.sparkSession)
    rows = drawn(docs, text_col, lang_col, max_docs, max_chars).toPandas().sort_values(["lang", "h"], kind="stable")
    fit, held = {}, {}
    for lang, own in rows.groupby("lang"):
        texts = own.text.tolist()
        held[lang] = texts[::5] if len(texts) >= 50 else []
        fit[lang] = [t for i, t in enumerate(texts) if i % 5] if len(texts) >= 50 else texts
    models = CharModels.fit(fit, order)
    models.calibrate(held)
    return models


def identify(docs: DataFrame, models: CharModels, text_col: str = "text") -> DataFrame:
    """For each row: its columns, lang_pred, lang_score, rejected. The models are bounded by the
    sample they were fitted on and sent to each worker."""
    importable(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(models)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            langs, score, rejected = sent.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[f"c{i}" for i in range(batch.num_columns + 3)])

    kinds = [*[f.dataType for f in docs.schema], StringType(), DoubleType(), BooleanType()]
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    out = own.mapInArrow(run, StructType([StructField(f"c{i}", k) for i, k in enumerate(kinds)]))
    return out.toDF(*docs.columns, *free_names(docs, "lang_pred", "lang_score", "rejected"))


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    models = learn(docs.filter(~held_out("doc_id")))
    out = identify(docs.select("doc_id", "text", held_out("doc_id").alias("held_out")), models)
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), "rejected")
