"""Line deduplication over levelled sorted runs of line hashes, in DataFrame operations only.

Each batch of documents has one row for each line key: the number of its documents that hold it
and the largest id among them. The batch is merge-joined with the keys of the runs there are: keys
that no run has (the anti join) are added as the batch's own sorted run, what it says of known keys
is kept as an increment. Runs of one level are compacted into one run of the next level whenever
``fanout`` of them have gathered, so a batch meets few runs, and every key lies in one of them.

Runs are tables bucketed and sorted by key in the shared folder, all in the same number of buckets: a
batch moves once, to those buckets, and meets every run there; runs are neither moved nor sorted again.

Defined results: null or empty text is one empty line; a null id sorts below every number;
repeated rows (same id) count as one document and share a decision; texts that share an id are one
document when lines are counted and are cut each; an empty table gives an empty result; all columns
are kept, and a result column whose name the input has already gets an underscore behind it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planwright.llm.common import SPACE, ascii_lower, documents, free_names, keep_path, set_for, shuffle_parts, written

#: Lets a scan of a bucket that is one file say that it is sorted.
_ORDERED = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.bucketing.coalesceBucketsInJoin.enabled": "false"}


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(SPACE)))


@dataclass
class LineRuns:
    """Levels of sorted runs (h1, h2, n_docs, top), no key in two of them: level i holds runs of
    about fanout**i batches. What later batches say of known keys waits in ``increments``."""

    spark: SparkSession
    fanout: int = 4
    levels: list[list[DataFrame]] = field(default_factory=list)
    increments: list[DataFrame] = field(default_factory=list)
    tables: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.buckets = shuffle_parts(self.spark)

    def add(self, run: DataFrame) -> None:
        """``run``: one row for each key of a batch; the documents of batches are disjoint. A merge
        join with each run parts it: new keys are its own run, the others increments."""
        told = self._sorted(self.met(run))
        self._put(told.filter("not old").drop("old"), 0)
        if len(self.levels) > 1 or len(self.levels[0]) > 1:
            self.increments.append(told.filter("old").drop("old"))
        if len(self.increments) >= self.fanout:
            self.increments = [self._sorted(_merged(_union(self.increments)))]

    def met(self, run: DataFrame) -> DataFrame:
        """``run`` with ``old``: whether one of the runs has the key."""
        old = F.lit(False)
        for i, held in enumerate(self._runs()):
            run = run.join(held.select("h1", "h2", F.lit(True).alias(f"in{i}")).hint("merge"), ["h1", "h2"], "left")
            old = old | F.col(f"in{i}").isNotNull()
        return run.select("h1", "h2", "n_docs", "top", old.alias("old"))

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(self._sorted(_merged(_union(full))), level + 1)

    def _sorted(self, rows: DataFrame) -> DataFrame:
        """``rows``, which come from a join or a grouping by key, as a table of buckets: as those deal
        rows the way buckets do, a bucket is one file, in the order of the key."""
        name = f"planwright_run_{uuid.uuid4().hex}"
        with set_for(self.spark, _ORDERED):
            rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", keep_path(self.spark, "run")).saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def _runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def compacted(self) -> DataFrame:
        """All keys with what all batches say of them."""
        return _merged(_union([*self._runs(), *self.increments]))

    def close(self) -> None:
        """Take the runs out of the session's catalog."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.clear()


def _union(runs: list[DataFrame]) -> DataFrame:
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("top").alias("top"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dropped_lines(docs: DataFrame, min_chars: int, min_docs: int, batches: int, fanout: int = 4) -> DataFrame:
    """``docs`` (id, th, text) -> (id, th, lost): of each text that loses lines, their places."""
    key = line_key(F.col("line"))
    keyed = (
        docs.select("id", "th", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        .filter(F.length("line") >= min_chars)
        .select("id", "th", "pos", key.alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(0x5BD1E995), "key").alias("h2"))
    )
    keyed = written(keyed.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")), "lines", "batch")
    runs = LineRuns(docs.sparkSession, fanout)
    for b in range(batches):
        once = keyed.filter(F.col("batch") == b).select("h1", "h2", "id").distinct()  # a document counts once
        runs.add(once.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("id").alias("top")))
    frequent = written(runs.compacted().filter(F.col("n_docs") >= min_docs), "frequent")
    runs.close()
    lost = keyed.join(frequent, ["h1", "h2"]).filter(~F.col("id").eqNullSafe(F.col("top")))
    return lost.groupBy("id", "th").agg(F.collect_set("pos").alias("lost"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 4) -> DataFrame:
    """``docs`` with all its columns, the text rid of repeated lines, and n_lines, n_dropped.

    A key (line stripped of ASCII white space, A-Z lower-cased) of at least ``min_chars`` code
    points found in at least ``min_docs`` documents stays only in the largest id that holds it.
    """
    names = docs.columns
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])  # whatever the columns are called
    ident, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    th = F.xxhash64(text)
    lost = dropped_lines(own.select(F.col(ident).alias("id"), th.alias("th"), F.col(text).alias("text")), min_chars, min_docs, batches)
    joined = own.join(lost, F.col(ident).eqNullSafe(F.col("id")) & (th == F.col("th")), "left").withColumn("lines", _lines(F.col(text)))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    kept = F.transform(places, lambda i: F.get(F.col("lines"), i))
    n = F.size("lines").cast("long")
    gone = F.when(F.col("lost").isNull(), F.lit(0).cast("long")).otherwise(n - F.size(places))
    out = joined.select(*[F.when(F.col("lost").isNull(), F.col(c)).otherwise(F.array_join(kept, "\n")).alias(c) if c == text else F.col(c) for c in own.columns], n.alias("n_lines"), gone.alias("n_dropped"))
    return out.toDF(*names, *free_names(docs, "n_lines", "n_dropped"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, i, parts[i] AS line FROM (
    SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
frequent AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT d.doc_id, d.i, d.line, f.k IS NOT NULL AND d.doc_id <> f.top AS dropped
  FROM keyed d LEFT JOIN frequent f ON d.k = f.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
