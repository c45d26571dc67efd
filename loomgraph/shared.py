"""Tables between the steps of a job, in a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: While a step writes its table: its shuffles go when it is done, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir.

    Where the setting is missing, a temporary folder takes its place in a session on one machine (one for each
    application); on a cluster that is an error, as executors would not see the folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _LOCAL.get(context.applicationId)
        if base is None:
            base = _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it: lineage ends there, and a lost executor costs nothing."""
    path = shared_dir(df.sparkSession, name)
    with _shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As materialise, in buckets by a column, as many as a shuffle has partitions: joins on it don't shuffle the table.
    Compressed more, as such a table holds texts.  The catalogue has it only until its plan is made."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    entry = "loomgraph_" + uuid.uuid4().hex
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).options(path=path, compression="zstd").saveAsTable(entry, format="parquet")
    table = spark.table(entry)
    spark.sql(f"drop table {entry}")  # an external table: its files stay
    return table
