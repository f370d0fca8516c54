"""Tables that a session goes over again: written once, read where they lie.

A table read from files has a short plan, whatever made it, and outlives lost executors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str | None:
    """``spark.checkpoint.dir``; on one machine a temporary folder if that is unset, on a cluster none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not where and (master == "local" or master.startswith("local[")):
        where = f"file://{tempfile.mkdtemp(prefix='tessella-')}"
    return where.rstrip("/") if where else None


class Store:
    """A folder of its own in ``spark.checkpoint.dir``, which driver and executors share.

    On one machine it may be a temporary folder; a cluster without the setting keeps tables
    by ``persist``.  The folder goes when the JVM ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._folder: str | None = None
        self._paths: dict[int, tuple[DataFrame, str | None]] = {}

    def _path(self) -> str | None:
        if self._folder is None:
            where = shared_dir(self.spark)
            if not where:
                return None
            self._folder = f"{where}/session-{uuid.uuid4().hex}"
            files, at = self._at(self._folder)
            files.mkdirs(at)
            files.deleteOnExit(at)
        return f"{self._folder}/{uuid.uuid4().hex}"

    def _at(self, path: str) -> tuple:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def keep(self, df: DataFrame) -> DataFrame:
        """The same rows, held; columns are written under plain names."""
        path = self._path()
        if path is None:
            held = df.persist()
        else:
            plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
            plain.write.parquet(path)
            held = self.spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)
        self._paths[id(held)] = (held, path)
        return held

    def drop(self, held: DataFrame) -> None:
        """Gives up a kept table; others are left alone."""
        _, path = self._paths.pop(id(held), (None, None))
        if path:
            files, at = self._at(path)
            files.delete(at, True)
        else:
            held.unpersist()
