import importlib
import re

from pyspark.sql import functions as F

import corpus_pipeline as cp
from planwright.llm import language_id, line_dedup, near_dedup, span_dedup
from planwright.llm.common import written


def ids(df):
    return sorted((r[0] for r in df.select("doc_id").collect()), key=repr)


def test_stages_take_effect_and_keep_the_columns(spark, docs, corpus):
    assert 4 <= len(cp.STAGES) <= 5
    now = docs
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, now, "").cache()
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        if name == "language":
            judged = language_id.identify(now, language_id.learn(now))
            assert ids(out) == ids(judged.filter("not rejected"))
        elif name == "lines":
            assert ids(out) == ids(now)
            assert sorted(r.text or "" for r in out.collect()) == sorted(r.text or "" for r in line_dedup.line_dedup(now).collect())
        elif name == "near":
            kept = {r.doc_id for r in near_dedup.near_dedup(now).filter("kept").collect()}
            assert set(ids(out)) == kept and out.count() < now.count()
            assert out.count() == out.select("doc_id", "text").distinct().count()
        elif name == "spans":
            full = span_dedup.span_dedup(now).collect()
            assert ids(out) == sorted((r.doc_id for r in full if not r.n_units or r.n_removed < r.n_units), key=repr)
            assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in out.collect())
        now = out
    packed = cp.STAGES[-1][1](spark, now, "")
    assert set(ids(packed)) == set(ids(now))


def test_empty_table(spark, nothing):
    now = nothing
    for _, stage in cp.STAGES:
        now = stage(spark, now, "")
    assert now.count() == 0


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert "pipeline" in names and set(entry.oracle_sql()) <= names
    found = {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))}
    assert found == set(range(1, 11))


def test_columns_with_names_of_results_stay(spark, docs):
    """A table that already has what the operators call their results, under just these names."""
    names = ["rejected", "lang_pred", "lang_score", "n_lines", "n_dropped", "n_units", "n_removed", "kept", "n_shingles", "component_id", "th", "id", "copies", "c0", "old", "batch", "lost", "place"]
    now, plain = docs.withColumns({c: F.concat(F.lit(f"my {c} "), F.coalesce(F.col("text"), F.lit(""))) for c in names}), docs
    origin = {r.text or "": r for r in now.collect()}
    for name, stage in cp.STAGES[:-1]:
        now, plain = stage(spark, now, "").cache(), stage(spark, plain, "").cache()
        assert now.dtypes == docs.withColumns({c: F.lit("") for c in names}).dtypes
        assert sorted(map(str, now.select(*plain.columns).collect())) == sorted(map(str, plain.collect())), name
        for r in now.collect():
            assert all(r[c].startswith(f"my {c} ") for c in names) and len({r[c][len(f"my {c} ") :] for c in names}) == 1
    assert now.count() and origin
    assert cp.STAGES[-1][1](spark, now, "").count() == cp.STAGES[-1][1](spark, plain, "").count()


def test_many_equal_rows_and_null_ids(spark):
    """A third of all rows is one row, another third has no id."""
    prose = "der die das und ist nicht mit auf ein eine dem den von zu im sich des als auch an es nach wie "
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 3 == 1, F.col("id") + 10).cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(prose * 3)).otherwise(F.concat(F.lit("text "), "id", F.lit(" of row "), "id")).alias("text"), F.lit("de").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    now = rows
    for name, stage in cp.STAGES:
        now = stage(spark, now, "")
        if name != "packing":
            now = written(now, "test")
    assert now.filter("doc_id = 5").select("doc_id").distinct().count() == 1
    assert now.count() == 20_001
