"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_temporary: dict[str, str] = {}
#: Spark's own setting that removes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset and the master is this machine, below a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _temporary.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="structpeak-")
        _temporary[spark.sparkContext.applicationId] = root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_stored: dict[int, str] = {}
_tables: dict[int, str] = {}


def _written(df: DataFrame, path: str, write: Callable[[], None]) -> DataFrame:
    spark = df.sparkSession
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # once the step is stored nothing reads its shuffle files
    try:
        write()
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    _stored[id(out)] = path
    weakref.finalize(out, _stored.pop, id(out), None)
    return out


def saved(df: DataFrame, name: str = "step", compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: later jobs start from there, lost executors or not."""
    path = shared_folder(df.sparkSession, name)
    return _written(df, path, lambda: df.write.parquet(path, compression=compression))


def saved_by(df: DataFrame, key: str, name: str, compression: str = "snappy") -> tuple[DataFrame, DataFrame]:
    """As ``saved``, in buckets of ``key``; then the same files as a table of buckets, whose rows stay in place when it is joined by ``key``."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    table, n = path.rpartition("/")[2].replace("-", "_"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    write = df.write.format("parquet").option("path", path).option("compression", compression).bucketBy(n, key)
    out = _written(df, path, lambda: write.saveAsTable(table))
    by_key = spark.table(table)
    _tables[id(out)] = table
    return out, by_key


def discard(*steps: DataFrame) -> None:
    """Deletes stored steps, once all that was made from them is stored itself."""
    for df in steps:
        path, table = _stored.pop(id(df), None), _tables.pop(id(df), None)
        if table:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
