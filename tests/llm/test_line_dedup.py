import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from planwright.llm import line_dedup as ld
from planwright.llm.common import SPACE


def ascii_lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def brute(rows, min_chars, min_docs):
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            k = ascii_lower(line.strip(SPACE))
            if len(k) >= min_chars:
                holders[k].add(i)
    low = lambda i: -1 if i is None else i
    frequent = {k: max(v, key=low) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if frequent.get(ascii_lower(x.strip(SPACE)), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    df = df.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256))
    return sorted(map(tuple, df.collect()), key=repr)


def test_same_as_brute_force(corpus, docs, clashing):
    assert result(ld.line_dedup(docs)) == brute(corpus, 40, 5)
    assert any(r[2] for r in brute(corpus, 40, 5))
    assert result(ld.line_dedup(clashing, min_chars=3, min_docs=2, batches=6)) == brute(corpus, 3, 2)


def test_levels_are_compacted(spark, docs):
    runs = ld.LineRuns(spark, fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(k, k, 1, b) for k in range(b, b + 4)], "h1 long, h2 long, n_docs long, top int"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    found = {r.h1: (r.n_docs, r.top) for r in runs.compacted().collect()}
    assert found == {k: (sum(b <= k < b + 4 for b in range(5)), max(b for b in range(5) if b <= k < b + 4)) for k in range(8)}


def test_runs_are_neither_moved_nor_sorted_again(spark):
    batch = lambda b: spark.range(b * 500, b * 500 + 2000).selectExpr("xxhash64(id) as h1", "id as h2").groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("h2").alias("top"))
    runs = ld.LineRuns(spark, fanout=3)
    for b in range(4):
        runs.add(batch(b))
    assert [len(level) for level in runs.levels] == [1, 1]
    with ld.set_for(spark, ld._ORDERED):
        met = runs.met(batch(4))
        plan = met._jdf.queryExecution().executedPlan().toString().splitlines()
    count = lambda what: sum(bool(re.search(what, line)) for line in plan)
    assert count("FileScan") == 2 and count("SortMergeJoin") == 2
    assert count("Exchange") == 1 and count(r"- Sort \[") == 1  # both of the batch
    assert met.filter("old").count() == 1500
    runs.close()


def test_result_names_and_values_of_the_input_stay(docs):
    mine = docs.withColumn("n_lines", F.lit(-7)).withColumn("n_dropped", F.lit("mine"))
    out = ld.line_dedup(mine)
    assert out.columns == [*mine.columns, "n_lines_", "n_dropped_"]
    assert out.select("n_lines", "n_dropped").distinct().collect() == [(-7, "mine")]


def test_many_rows_of_one_id(spark, corpus):
    texts = [t for _, t, *_ in corpus][:90]
    for ident, value in (("null", None), ("5", 5)):
        rows = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr(f"cast({ident} as long) as doc_id", "text")
        assert result(ld.line_dedup(rows, min_chars=3, min_docs=2)) == brute([(value, t) for t in texts], 3, 2)
    line = "a line of text that is long enough to be a key"
    same = spark.range(30_000).select(F.lit(7).alias("doc_id"), F.lit(f"{line}\n{line}").alias("text"))
    same = same.unionByName(spark.range(10, 16).select(F.col("id").cast("int").alias("doc_id"), F.lit(line).alias("text")))
    out = ld.line_dedup(same).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_dropped").alias("d")).collect()
    assert {r.doc_id: (r.n, r.d) for r in out} == {7: (30_000, 60_000), **{i: (1, 1) for i in range(10, 15)}, 15: (1, 0)}


def test_empty_and_columns(nothing, clashing):
    assert ld.line_dedup(nothing).count() == 0
    assert set(clashing.columns) <= set(ld.line_dedup(clashing).columns)
    assert "Python" not in ld.line_dedup(clashing)._jdf.queryExecution().executedPlan().toString()
