"""Cutting the lineage of iterative jobs so that they survive lost executors, and scratch paths in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local master without it gets a temporary folder, a cluster an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="meshwork-checkpoint-"))
        own = spark.sparkContext.getCheckpointDir()
    return own


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder; one of a session that is gone stays with the folder's owner."""
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - at exit the JVM may have gone first
        pass


def written(df: DataFrame) -> DataFrame:
    """df computed once, as a Parquet table in the shared folder until the session ends.

    Unlike a checkpoint it carries no constraints of the plan that made it, which in loops pile up from round to round,
    and brings the sizes that joins are planned by.
    """
    path = scratch(df.sparkSession, "table")
    atexit.register(forget, df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def partition_places() -> tuple[Column, Column]:
    """_part and _place: a row's partition and its place in it, from 0."""
    return F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_place")


def partition_starts(placed: DataFrame) -> DataFrame:
    """(_part, _start): rows in all partitions before; one row per partition, so the driver can hold them."""
    rows, start = [], 0
    for r in sorted(placed.groupBy("_part").count().collect(), key=lambda r: r["_part"]):
        rows.append((r["_part"], start))
        start += r["count"]
    return placed.sparkSession.createDataFrame(rows, "_part int, _start long")
