"""What several operators share: words, shared tables and Arrow batch sizes."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a Java regular expression class.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows in one Arrow batch: texts are long, and a batch is held in memory as a whole.
BATCH_ROWS = 512

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session, where there is one machine, may get a temporary folder
    when the setting is missing; a cluster without the setting is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    where = f"file://{tempfile.mkdtemp(prefix='tessella-')}"
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def _at(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    files, at = _at(spark, path)
    files.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _at(spark, path)
    return files.exists(at)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended before
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder, and read from there.

    It cuts the lineage: if an executor is lost, the table is still there.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of data frames that are gone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: A key is hot if it has more than this part of all rows.
HOT = 1000


def join_by_key(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``left`` and ``right`` by ``key``, where ``right`` has a row a key that says in ``weight`` how many rows ``left`` has of it.

    Keys with over a thousandth of the ``total`` rows, of which there are less than a
    thousand, are broadcast, so that no task gets a hot key's rows; all others are shuffled.
    """
    hot = F.broadcast(right.filter(F.col(weight) * HOT > total))
    rest = left.join(hot.select(key), key, "left_anti").join(right.filter(F.col(weight) * HOT <= total), key)
    return left.join(hot, key).unionByName(rest).drop(weight)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows that Python holds at once, unless the session bounds them lower."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def ascii_lower(col):
    """A-Z lower-cased, all else as it is."""
    return F.translate(col, UPPER, LOWER)


def column(name: str):
    """The column of exactly that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(taken: list[str], *names: str) -> list[str]:
    """The names, each lengthened until no column has it (in any case)."""
    have, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in have:
            name = f"{name}_"
        have.add(name.lower())
        out.append(name)
    return out


def refuse(id_col: str, *results: str) -> None:
    """An id column can't have the name of a result."""
    if id_col.lower() in {r.lower() for r in results}:
        raise ValueError(f"{id_col} is the name of a feature or a result; rename the id column")


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` but those names, in any case."""
    return [c for c in df.columns if c.lower() not in {n.lower() for n in names}]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
