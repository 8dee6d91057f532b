"""Change feeds: name-status and numstat text, and folders watched as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle import schemas
from brindle.functions import paths


def name_status(lines: DataFrame, value: str = "value") -> DataFrame:
    """(status, change_type, path, old_path) of lines ``M<tab>path`` or ``R100<tab>old<tab>new``; ``?? path`` counts as added."""
    porcelain = F.regexp_extract(value, r"^\?\? (.*)$", 1)
    parts = F.split(F.when(porcelain != "", F.concat(F.lit("A\t"), porcelain)).otherwise(F.col(value)), "\t")
    code = F.substring(parts[0], 1, 1)
    moved = code.isin("R", "C") & (F.size(parts) > 2)
    kind = F.when(code == "A", "added").when(code == "D", "deleted").when(code == "R", "renamed").when(code == "C", "added").otherwise("modified")
    rows = lines.select(parts[0].alias("status"), kind.alias("change_type"), F.when(moved, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))).alias("path"), F.when(moved, F.get(parts, F.lit(1))).alias("old_path"))
    return rows.filter(F.col("path") != "")


def numstat(lines: DataFrame, value: str = "value") -> DataFrame:
    """(path, additions, deletions) of lines ``1<tab>2<tab>path``; binary files (-) have null counts. ``a/{b => c}/d`` is the new path."""
    parts = F.split(value, "\t")
    path = F.regexp_replace(F.regexp_replace(F.get(parts, F.lit(2)), r"\{[^{}]* => ([^{}]*)\}", "$1"), r"^.* => ", "")
    return lines.filter(F.size(parts) >= 3).select(F.regexp_replace(path, "//", "/").alias("path"), F.expr(f"try_cast(split({value}, '\\t')[0] as int)").alias("additions"), F.expr(f"try_cast(split({value}, '\\t')[1] as int)").alias("deletions"))


def staged_files(statuses: DataFrame, counts: DataFrame) -> DataFrame:
    """Staged files with their line counts; files without counts have none."""
    return statuses.join(counts, "path", "left").withColumn("language", F.when(F.col("path").rlike(r"\.pyi?$"), "python").otherwise("other"))


def poll(statuses: DataFrame, ts: str = "ts", content: str = "content") -> DataFrame:
    """Watched changes of (path, change_type, ts, old_path, content), each path and content once: the first poll that saw it."""
    rows = statuses.filter(paths.watched(F.col("path")))
    order = W.partitionBy("path", F.sha2(F.coalesce(F.col(content), F.col("change_type")), 256)).orderBy(ts)
    return rows.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def watch(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """A stream of changes (JSON lines in the schema of changes) from a landing folder; only watched paths."""
    rows = spark.readStream.schema(schemas.CHANGES).option("maxFilesPerTrigger", max_files).json(folder)
    return rows.filter(paths.watched(F.col("file_path")))


def event_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))


def times(df: DataFrame, key: str, tie: str, ts: str = "ts") -> DataFrame:
    """``df`` with epoch_ms, the time in milliseconds, and seconds_since, the whole seconds since the row before of the same key."""
    at = F.col(ts).cast("timestamp")
    before = F.lag(at).over(W.partitionBy(key).orderBy(at, tie))
    return df.withColumn("epoch_ms", F.unix_millis(at)).withColumn("seconds_since", F.timestamp_diff("SECOND", before, at))
