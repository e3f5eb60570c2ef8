"""Document fingerprints from closed syncmers, in DataFrame operations only.

A text is cut into words (a character at a time in scripts that do not put spaces between words, and
words of more than ``LONG`` characters into pieces of so many); a text of at most ``SHORT`` characters
is cut into its characters, so that an edit of a few words or of one long string leaves most of it.
Of all runs of ``K`` of these, a closed syncmer is one whose smallest inner run of ``S``, by
hash, is its first or its last. That depends on nothing around the run, so two texts that share a
passage choose the same anchors in it. The fingerprint is the ``SKETCH`` smallest hashes of the
syncmers; the likeness of two fingerprints estimates the Jaccard similarity of the syncmer sets
(and is exact when both are smaller than the sketch).

Defined results: null text counts as empty; a text of white space has the empty fingerprint; another
one without a syncmer is one anchor as a whole; two equal fingerprints have likeness 1, an
empty and another one 0; rows that share an id follow each other in the order of their text; a
null id comes after all others; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planwright.llm.common import documents

#: Words of a run, words of an inner run, hashes of a fingerprint.
K, S, SKETCH = 5, 2, 64
#: Characters of a text that is taken by characters; characters of a piece of a word.
SHORT, LONG = 256, 16
#: Rows that are put in order together when each document is matched with the one after it.
ROWS_IN_ORDER = 2048
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_WORD = rf"[{_UNSPACED}]|[^\s{_UNSPACED}]{{1,{LONG}}}"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def syncmers(text: Column) -> Column:
    """Array of (position, hash) of the closed syncmers of a text; positions count words (or
    characters) from 0."""
    text = F.coalesce(text, F.lit(""))
    by_character = F.regexp_extract_all(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit("(?s)."), 0)
    parts = F.when(F.length(text) <= SHORT, by_character).otherwise(F.regexp_extract_all(text, F.lit(_WORD), 0))
    words = F.transform(parts, lambda w: F.xxhash64(w))
    n_inner = K - S + 1

    def choose(inner: Column) -> Column:
        shifted = F.arrays_zip(*[F.slice(inner, F.lit(i + 1), F.greatest(F.size(inner) - (n_inner - 1), F.lit(0))).alias(f"m{i}") for i in range(n_inner)])
        placed = F.transform(shifted, lambda z, i: F.struct(i.alias("pos"), z.alias("m")))
        edge = lambda p: F.least(p["m"]["m0"], p["m"][f"m{n_inner - 1}"]) <= F.least(*[p["m"][f"m{i}"] for i in range(1, n_inner - 1)])
        # The inner runs at every second place and the last one spell the whole run.
        spelt = lambda p: F.xxhash64(*[p["m"][f"m{i}"] for i in sorted({*range(0, n_inner, S), n_inner - 1})])
        return F.transform(F.filter(placed, edge), lambda p: F.struct(p["pos"].alias("pos"), spelt(p).alias("hash")))

    def of_words(h: Column) -> Column:
        inner = F.zip_with(F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))), F.slice(h, F.lit(2), F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
        whole = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(h).alias("hash")))
        chosen = _let(inner, choose)
        return _let(chosen, lambda c: F.when((F.size(c) == 0) & (F.size(h) > 0), whole).otherwise(c))

    return _let(words, of_words)


def sketch(text: Column) -> Column:
    """The smallest hashes (32 bits each) of the syncmers of a text, ascending."""
    return F.slice(F.sort_array(F.array_distinct(F.transform(syncmers(text), lambda s: F.shiftrightunsigned(s["hash"], 32)))), 1, SKETCH)


def spell(sketch_col: Column) -> Column:
    return F.array_join(F.transform(sketch_col, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the smallest hashes of both sketches that both of them hold."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, 1.0).otherwise(shared / F.size(both))


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each syncmer: id, pos (words before it), hash - for positional matching."""
    return docs.select(id_col, F.explode(syncmers(F.col(text_col))).alias("s")).select(id_col, "s.pos", "s.hash")


def with_next(docs: DataFrame, id_col: str, carried: list[str]) -> DataFrame:
    """Each row with ``next_<c>`` of the next row by descending id (after the last: the first).

    Rows are dealt by ranges of the id into buckets of about ``ROWS_IN_ORDER`` rows. The largest
    id of each bucket also goes to the bucket above it as a guest, so no row looks further than
    its own bucket. On the driver there are only the ranges' ends.
    """
    spark = docs.sparkSession
    n = docs.select(id_col).count()
    buckets = min(16_384, max(1, n // ROWS_IN_ORDER))
    cuts: list[int] = []
    if buckets > 1:
        shares = [i / buckets for i in range(1, buckets)]
        found = docs.agg(F.percentile_approx(id_col, shares, max(10_000, buckets * 10)).alias("q")).first()["q"] or []
        cuts = sorted(set(found))
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(id_col))) if cuts else F.lit(0)
    bucket = F.when(F.col(id_col).isNull(), 0).otherwise(bucket)
    tops = docs.select(bucket.alias("b"), F.col(id_col).alias("i")).groupBy("b").agg(F.max("i").alias("i")).orderBy("b").collect()
    guest = spark.createDataFrame([(t["i"], tops[(k + 1) % len(tops)]["b"]) for k, t in enumerate(tops)], f"__top {docs.schema[id_col].dataType.simpleString()}, __to int")
    rows = docs.withColumn("__b", bucket).join(F.broadcast(guest), F.col(id_col).eqNullSafe(F.col("__top")), "left")
    own, visit = F.struct(F.col("__b").alias("b"), F.lit(False).alias("guest")), F.struct(F.col("__to").alias("b"), F.lit(True).alias("guest"))
    rows = rows.withColumn("__at", F.explode(F.when(F.col("__to").isNull(), F.array(own)).otherwise(F.array(own, visit)))).withColumns({"__b": F.col("__at.b"), "__guest": F.col("__at.guest")}).drop("__at", "__top", "__to")
    order = Window.partitionBy("__b").orderBy(F.col("__guest"), F.col(id_col).desc_nulls_last(), *[F.col(c) for c in carried])
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
    return rows.filter(~F.col("__guest")).drop("__b", "__guest")


def op1_syncmer_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("sketch", sketch(F.col("text")))
    rows = with_next(docs, "doc_id", ["text", "sketch"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third)))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "sketch", sketch(F.col("edited")).alias("edited_sketch"), "next_sketch")
    return rows.select("doc_id", "n_chars", "edited_sha256", spell(F.col("sketch")).alias("fingerprint"), spell(F.col("edited_sketch")).alias("edited_fingerprint"), likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
