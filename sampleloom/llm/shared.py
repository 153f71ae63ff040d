"""Shared tables and small helpers used by the operators of this package.

Lineage is cut by writing Parquet tables below the folder named by
``spark.checkpoint.dir``, which every executor of a cluster can read.  Only a
local session that names no such folder (tests, notebooks) gets one of its own.
"""

from __future__ import annotations

import atexit
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_FALLBACK = "file:///tmp/checkpoints/sampleloom"
_written: list[tuple[SparkSession, str]] = []
_path_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()

ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL_FALLBACK


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Hand whole documents to Python workers in small batches, unless the session sets a size of its own."""
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, str(rows))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame over the written table."""
    spark = df.sparkSession
    bound_batches(spark)
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and that nothing reads any more."""
    for table in tables:
        delete_path(table.sparkSession, _path_of.pop(table))


def release() -> None:
    """Delete the tables that operators wrote; call it once their results are stored."""
    while _written:
        spark, path = _written.pop()
        try:
            delete_path(spark, path)
        except Exception:  # the session may be gone at exit; the folder's own retention applies then
            return


atexit.register(release)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, UPPER.lower())


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
