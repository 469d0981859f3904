"""Session helpers: timezone, shared scratch folder, written intermediate tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


# Plans of this library hold many generated classes. Spark keeps 100 compiled ones by default and
# then compiles the same code again for every query, which costs more than small queries run.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.cache.maxEntries": "5000",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings this library runs well with; master, memory and partitions stay the caller's."""
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    return builder


def use_utc(spark: SparkSession) -> None:
    """All race times are UTC; a session in another zone would shift day and hour slots."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Without the setting, a local master, where driver and executors are one machine, uses a folder
    in the warehouse of its session.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get(CHECKPOINT_CONF, None) or spark.conf.get(CHECKPOINT_CONF, None)
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if configured or current:
        base = configured or current
    elif sc.master.startswith("local"):
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/trackline-{uuid.uuid4().hex}"
        remove_at_end(spark, base)
    else:
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    if current is None:
        sc.setCheckpointDir(base)
    return base


def remove_at_end(spark: SparkSession, path: str) -> str:
    """Have the file system remove a path when the driver ends."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    return remove_at_end(spark, os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}"))


def write_shared(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a table to the shared folder and return it read back, with its lineage cut."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    writer = df.write.mode("errorifexists")
    if partition_by:
        # Few files per partition, and more than one for a partition too large for one task.
        writer = df.hint("rebalance", *partition_by).write.mode("errorifexists")
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)
