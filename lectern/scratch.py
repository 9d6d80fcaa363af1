"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: So many narrow rows are work for one task and one file, unless cores would be idle.
FILE_ROWS = 1 << 17

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset, as in tests, a temporary folder of the driver, for local masters only."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = f"file://{tempfile.mkdtemp(prefix='lectern-')}"
        folder = _own[app]
    return folder.rstrip("/")


class Scratch:
    """Tables written as Parquet and read again, which cuts lineage and survives lost executors.

    Those that a result still reads stay in the folder; it may go when the result is written.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def few(self, frame: DataFrame, rows: float) -> DataFrame:
        """frame in no more partitions than about so many narrow rows need, or than there are cores; it may have fewer."""
        return frame.coalesce(max(self.spark.sparkContext.defaultParallelism, math.ceil(rows / FILE_ROWS)))

    def keep(self, frame: DataFrame, name: str, compression: str = "zstd", rows: float | None = None) -> DataFrame:
        """rows: about the most that the table can have, in narrow rows: wide ones, also those it is made from, count as several.
        Else each partition is a file, however small, and a file costs its commit and, on a local disk without Hadoop's native library, processes that set its rights.
        """
        self._n += 1
        frame = frame if rows is None else self.few(frame, rows)
        path = f"{self.folder}/{self._n:03d}-{name}"
        frame.write.parquet(path, compression=compression)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, frame: DataFrame) -> None:
        """Deletes a table that keep() gave, once nothing reads it any more."""
        jvm = self.spark.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
