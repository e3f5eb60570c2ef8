"""A corpus pipeline: language ID, line dedup, near dedup, substring dedup, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` applies them to
``documents`` and writes each stage's result in the shared folder before the next reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwright.llm import language_id, line_dedup, near_dedup, packing, span_dedup
from planwright.llm.common import documents, written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models recognize; rejected ones go. ``lang`` stays as given.

    Null and empty texts, and texts without a letter, go; short texts, and all texts if no row has a
    label in a language of 50 texts, cannot be told to be strange and stay. Repeated rows are judged
    each. An empty table stays empty, and columns of any name stay as they are."""
    judged = language_id.identify(docs, language_id.learn(docs))
    return judged.filter(~F.col(f"`{judged.columns[-1]}`")).select(*[f"`{c}`" for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines stay in one document each; documents stay, n_chars follows the text.

    The document of the largest id keeps a line; a null id is below all others, and rows of one id are
    one document when lines are counted. Null text stays null, with null characters. An empty table
    stays empty, and columns of any name stay as they are."""
    return _measured(line_dedup.line_dedup(docs), docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, similarity 0.8): the one
    of the smallest id, null last; of rows that repeat id and text one.

    Documents without words are in no group and stay, but for repeated rows. Ties by id go to the
    smaller hash of the text. An empty table stays empty, and columns of any name stay as they are."""
    return near_dedup.one_of_each(docs)


def span_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated spans of sentences stay once, in the document of the smallest id; n_chars follows the
    text; a document left without a word goes.

    Null and empty texts lose nothing and stay. A null id comes first; rows that repeat id and text
    share a decision. An empty table stays empty, and columns of any name stay as they are."""
    out = span_dedup.span_dedup(docs)
    units, removed = (F.col(f"`{c}`") for c in out.columns[-2:])
    return _measured(out.filter((removed == 0) | (removed < units)), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in its bin: the last stage, with columns of its own.

    Null or empty text is one token; a null source is a source; repeated rows are packed each; an empty
    table gives no rows."""
    return packing.best_fit(docs)


def _measured(out: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, which come first, with n_chars as long as the text now is."""
    n = F.length("text").cast(like.schema["n_chars"].dataType)
    return out.select(*[n.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in out.columns[: len(like.columns)]])


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near", near_stage),
    ("spans", span_stage),
    ("packing", packing_stage),
]

#: The language models, the signatures and the packing are beyond SQL; tests hold each stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
