"""The registry of queries, and what they share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from brindle.session import shared_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_MADE: dict[tuple[str, str, str], tuple[str, Any]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its own name, with its SQL if there is one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than there are cores, dealt to all cores. Larger tables are read where they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, d: str) -> str:
    """A digest of the names, sizes and times of all files below a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(d)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    files = []
    while found.hasNext():
        status = found.next()
        files.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(files)).encode()).hexdigest()


def once(spark: SparkSession, what: str, d: str, make: Callable[[], Any]) -> Any:
    """What ``make`` stores, made by the first query of an application that asks for it over the folder ``d``, and again once files there have changed."""
    name, now = (spark.sparkContext.applicationId, what, d), fingerprint(spark, d)
    if name not in _MADE or _MADE[name][0] != now:
        _MADE[name] = (now, make())
    return _MADE[name][1]
