"""Validation of patches: findings of tools by stage, roll-ups and the verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STAGES = ("basic", "lint", "type")


def severity_counts(issues: DataFrame, *by: str) -> DataFrame:
    """(errors, warnings, notes, passed) of issues (severity), for each group; without errors it passed."""
    rows = issues.groupBy(*by).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("severity").isin("note", "info")).alias("notes"))
    return rows.withColumn("passed", F.col("errors") == 0)


def stage_rows(patches: DataFrame, issues: DataFrame, key: str = "patch", stages: tuple[str, ...] = STAGES) -> DataFrame:
    """(key, stage, position, errors, warnings, notes, passed) of every patch and stage, also without issues. issues: (key, stage, severity)."""
    every = patches.select(key).distinct().withColumn("stage", F.explode(F.array(*map(F.lit, stages))))
    counted = severity_counts(issues, key, "stage")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = every.join(counted, [key, "stage"], "left")
    return rows.select(key, "stage", (F.array_position(F.array(*map(F.lit, stages)), F.col("stage")) - 1).alias("position"), zero("errors"), zero("warnings"), zero("notes"), F.coalesce("passed", F.lit(True)).alias("passed"))


def roll_up(stages: DataFrame, key: str = "patch", continue_on_errors: bool = True) -> DataFrame:
    """(key, stages_run, stages_passed, stages_failed, errors, warnings, notes, passed); without ``continue_on_errors`` nothing after the first failed stage counts."""
    if not continue_on_errors:
        failed = F.min(F.when(~F.col("passed"), F.col("position"))).over(W.partitionBy(key))
        stages = stages.withColumn("__stop", failed).filter(F.col("__stop").isNull() | (F.col("position") <= F.col("__stop"))).drop("__stop")
    return stages.groupBy(key).agg(
        F.count(F.lit(1)).alias("stages_run"), F.count_if("passed").alias("stages_passed"), F.count_if(~F.col("passed")).alias("stages_failed"),
        F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"), F.sum("notes").alias("notes"), F.bool_and("passed").alias("passed"),
    )


def verdict(rolled: DataFrame, tests: DataFrame, key: str = "patch") -> DataFrame:
    """(key, constraints_passed, tests_passed, valid) of roll-ups and test summaries (key, all_passed); no test run is no pass."""
    rows = rolled.select(key, F.col("passed").alias("constraints_passed")).join(tests.select(key, F.col("all_passed").alias("tests_passed")), key, "left")
    rows = rows.withColumn("tests_passed", F.coalesce("tests_passed", F.lit(False)))
    return rows.withColumn("valid", F.col("constraints_passed") & F.col("tests_passed"))


def pipeline_metrics(stages: DataFrame) -> DataFrame:
    """(stages, successful, failed, seconds, first_failed) of pipeline stages (position, stage, ok, seconds)."""
    return stages.agg(F.count(F.lit(1)).alias("stages"), F.count_if("ok").alias("successful"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"), F.min_by(F.when(~F.col("ok"), F.col("stage")), F.when(~F.col("ok"), F.col("position"))).alias("first_failed"))


def latest(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """Of each key the row that is last by ``order``."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(c) if isinstance(c, str) else c.desc() for c in order]))
    return df.withColumn("__n", rank).filter("__n = 1").drop("__n")


def first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """Of each key the row that is first by ``order``."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", rank).filter("__n = 1").drop("__n")


def ring(events: DataFrame, n: int = 100, order: str = "ts") -> DataFrame:
    """The last ``n`` events."""
    return events.orderBy(F.desc(order)).limit(n)
