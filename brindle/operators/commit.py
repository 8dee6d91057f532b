"""Staged changes: summary, findings, recommendation, and decisions to ignore findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle import schemas
from brindle.functions.structure import syntax_error

LARGE_SCOPE, LARGE_DIFF, MANY_FILES = 5, 8, 8


def summarize(staged: DataFrame, *by: str) -> DataFrame:
    """(files, python_files, hunks, symbols, additions, deletions) of staged files; missing counts are 0."""
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    size = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    return staged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("language") == "python").alias("python_files"), total(size("hunks"), "hunks"), total(size("changedSymbols"), "symbols"), total("additions", "additions"), total("deletions", "deletions")
    )


def changed_symbols(staged: DataFrame) -> DataFrame:
    """(path, name, start_line, type, content): symbols of staged files, of equal (path, name, start line) the first."""
    rows = staged.select("path", F.posexplode("changedSymbols").alias("n", "s")).select("path", "n", "s.*")
    first = F.row_number().over(W.partitionBy("path", "name", "startLine").orderBy("n"))
    return rows.withColumn("__i", first).filter("__i = 1").select("path", "name", F.col("startLine").alias("start_line"), "type", "content")


def _finding(df: DataFrame, severity: str, file, reason, pattern: str, fix: str, status: str, *by: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(*by, F.lit(severity).alias("severity"), file.alias("affected_file"), none.alias("affected_symbol"), reason.alias("reason"), F.lit(pattern).alias("matched_pattern"), F.lit(fix).alias("suggested_fix"), F.lit(status).alias("validation_status"))


def syntax_findings(staged: DataFrame) -> DataFrame:
    """A blocker for each staged Python file whose new text does not parse."""
    bad = staged.filter((F.col("language") == "python") & F.col("newContent").isNotNull()).withColumn("error", syntax_error(F.col("newContent"))).filter("error is not null")
    return _finding(bad, "blocker", F.col("path"), F.col("error"), "python-syntax-error", "Fix the syntax error, stage the file and run the analysis again.", "failed")


def scope_findings(staged: DataFrame, *by: str) -> DataFrame:
    """Warnings for more than ``LARGE_SCOPE`` changed symbols in all, and for files of more than ``LARGE_DIFF`` hunks."""
    wide = summarize(staged, *by).filter(F.col("symbols") > LARGE_SCOPE)
    scope = _finding(wide, "warning", F.lit("*"), F.concat(F.lit("large symbol scope: "), F.col("symbols"), F.lit(" changed symbols")), "large-symbol-scope", "Review the symbols, or split the change.", "warning", *by)
    deep = staged.withColumn("n", F.array_size("hunks")).filter(F.col("n") > LARGE_DIFF)
    return scope.unionByName(_finding(deep, "warning", F.col("path"), F.concat(F.lit("large file diff: "), F.col("n"), F.lit(" staged hunks")), "large-file-diff", "Review the file, or split unrelated changes.", "warning", *by))


def recommend(summary: DataFrame, findings: DataFrame, diagnostics: DataFrame | None = None, *by: str) -> DataFrame:
    """``summary`` with a recommendation: blocked for a blocker, review for diagnostics, warnings, errors or a large change, else ready."""
    if by:
        levels = findings.groupBy(*by).agg(F.bool_or(F.col("severity") == "blocker").alias("blocked"), F.bool_or(F.col("severity").isin("warning", "error")).alias("doubtful"))
        row = summary.join(levels, list(by), "left")
        row = row.join(diagnostics.select(*by).distinct().withColumn("failed", F.lit(True)), list(by), "left") if diagnostics is not None else row.withColumn("failed", F.lit(False))
    else:
        row = summary.join(findings.agg(F.bool_or(F.col("severity") == "blocker").alias("blocked"), F.bool_or(F.col("severity").isin("warning", "error")).alias("doubtful")))
        row = row.join(diagnostics.agg((F.count(F.lit(1)) > 0).alias("failed"))) if diagnostics is not None else row.withColumn("failed", F.lit(False))
    large = (F.col("symbols") > LARGE_SCOPE) | (F.col("files") > MANY_FILES)
    verdict = F.when(F.col("blocked"), "blocked").when(F.col("failed") | F.col("doubtful"), "review").when(F.col("files") == 0, "ready").when(large, "review").otherwise("ready")
    return row.withColumn("recommendation", verdict).drop("blocked", "doubtful", "failed")


def finding_key():
    """The key by which one finding is ignored once."""
    return F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("affected_file", "affected_symbol", "matched_pattern", "reason")])


def split_ignored(findings: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Active and ignored findings, by decisions (type once or pattern, key)."""
    once = decisions.filter("type = 'once'").select(F.col("key").alias("__key")).distinct()
    patterns = decisions.filter("type = 'pattern'").select(F.col("key").alias("matched_pattern")).distinct()
    keyed = findings.withColumn("__key", finding_key())
    active = keyed.join(once, "__key", "left_anti").join(patterns, "matched_pattern", "left_anti")
    by_key = keyed.join(once, "__key", "left_semi")
    by_pattern = keyed.join(once, "__key", "left_anti").join(patterns, "matched_pattern", "left_semi")
    return active.select(*findings.columns), by_key.unionByName(by_pattern).select(*findings.columns)


def by_file(findings: DataFrame) -> DataFrame:
    """Findings of each file by severity, as columns."""
    return findings.groupBy("affected_file").pivot("severity", list(schemas.SEVERITIES)).count().na.fill(0)
