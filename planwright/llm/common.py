"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the word and line contracts name it: space and tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Bytes that go to a Python worker at once: whatever the rows, the buffers of a task stay small.
_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is missing (tests, a local session) a temporary folder of this
    machine takes its place; a cluster is expected to name its own.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        root = _written.setdefault("", [tempfile.mkdtemp(prefix="planwright-")])[0]
    return root.rstrip("/")


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it. On a cluster whose
    machines do not share that path, ship the package with ``--py-files``."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


@contextmanager
def set_for(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the time of an action; what was there before comes back."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def keep_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes by ``forget``."""
    path = f"{shared_dir(spark)}/planwright/{name}-{uuid.uuid4().hex}"
    if "paths" not in _written:
        _written["paths"] = []
        atexit.register(forget)
    _written["paths"].append(path)
    return path


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage in a
    way that survives lost executors. The tables go when the Python process ends, or by
    ``forget``."""
    spark = df.sparkSession
    path = keep_path(spark, name)
    with set_for(spark, _BATCHES):
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(path)
    # Column names and types are known, so no job infers them and an empty table reads back too.
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession | None = None) -> None:
    """Delete the tables that ``written`` has left, as far as a session is there to do it."""
    spark = spark or SparkSession.getActiveSession()
    paths, _written["paths"] = _written.get("paths", []), []
    if spark is None or spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    for path in paths:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session is ending; what stays is a scratch table
            return


def ascii_lower(c: Column) -> Column:
    """A to Z in lower case, everything else as it is."""
    return F.translate(c, UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """Names for result columns beside those of ``docs``: one that is taken, in whatever case, gets
    underscores behind it until it is free."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
