"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwright.llm.common import written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): of each node of ``edges`` (a, b: long) the smallest node it reaches.

    Every round each node takes the smallest label among its neighbours, then the label of its
    label (so distances halve); minima are formed before rows move. A round is a written table.
    """
    both = edges.select("a", "b").filter("a <> b")
    both = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        step = written(step, "labels")
        jump = step.select(F.col("node").alias("of"), F.col("label").alias("further"))
        done = written(step.join(jump, step["label"] == jump["of"], "left").select("node", F.least("label", "further").alias("label"), "was"), "labels")
        labels = done.select("node", "label")
        if done.filter("label <> was").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
