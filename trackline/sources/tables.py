"""Writers and readers of finished tables."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

RACE_PARTITIONS = ("circuit", "race_number")


def publish_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def write_table(
    df: DataFrame, folder: str, name: str, partition_by: tuple[str, ...] = RACE_PARTITIONS
) -> str:
    """Replace a table by a full refresh; race partitions let page filters skip files.

    The rebalance hint gathers each race in few files of even size and divides a race that is too
    large for one task.
    """
    path = os.path.join(folder, name)
    keys = [c for c in partition_by if c in df.columns]
    writer = df.write.mode("overwrite")
    if keys:
        writer = df.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys)
    writer.parquet(path)
    return path


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, name))


class Versions:
    """Versions of all tables below one folder, of which readers see the one published last.

    Every refresh writes a folder of its own. Publishing it creates one empty file whose name
    holds a running number, the time and the version; a file is there or not, so a reader finds
    the old tables or the new ones, never some of both. Of two refreshes that publish at one time
    the later one counts. Readers that have opened a version keep it.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.folder = folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        place = self._path(f"{self.folder}/_published")
        if not self._fs.exists(place):
            return []
        names = (status.getPath().getName() for status in self._fs.listStatus(place))
        return sorted(name for name in names if name[0] not in "_.")

    def new(self) -> str:
        """The folder of a version that nobody reads yet."""
        return f"{self.folder}/_versions/{uuid.uuid4().hex}"

    def publish(self, version: str) -> None:
        """Let readers that come from now on see this version."""
        self._fs.mkdirs(self._path(f"{self.folder}/_published"))
        name = version.rstrip("/").rsplit("/", 1)[1]
        names = self._names()
        number = int(names[-1].split(".")[0]) + 1 if names else 0
        mark = f"{self.folder}/_published/{number:012d}.{time.time_ns():020d}-{name}"
        self._fs.create(self._path(mark), False).close()

    def current(self) -> str:
        """The folder of the version published last."""
        names = self._names()
        if not names:
            raise FileNotFoundError(f"no published tables below {self.folder}")
        return f"{self.folder}/_versions/{names[-1].split('-', 1)[1]}"

    def remove_old(self, keep: int = 2) -> None:
        """Delete all but the last ``keep`` published versions; readers must be done with them."""
        names = self._names()
        for name in names[: max(len(names) - max(keep, 1), 0)]:
            self._fs.delete(self._path(f"{self.folder}/_published/{name}"), False)
            self._fs.delete(self._path(f"{self.folder}/_versions/{name.split('-', 1)[1]}"), True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
