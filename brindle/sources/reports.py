"""Output of other tools as tables: traces, coverage, linters, type checkers, test runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle import schemas


def trace(outputs: DataFrame, key: str = "run", output: str = "stdout") -> DataFrame:
    """(key, events, call_counts, exit_code): the last line of each output that begins with ``{``; an empty trace where none parses."""
    lines = F.filter(F.split(F.coalesce(output, F.lit("")), "\n"), lambda s: F.ltrim(s).startswith("{"))
    parsed = F.from_json(F.try_element_at(lines, F.lit(-1)), schemas.TRACE)
    events = F.coalesce(parsed["events"], F.array().cast(schemas.TRACE.split(", call_counts")[0].removeprefix("events ")))
    return outputs.select(key, events.alias("events"), F.coalesce(parsed["call_counts"], F.create_map().cast("map<string,bigint>")).alias("call_counts"), F.coalesce(parsed["exit_code"], F.lit(-1)).alias("exit_code"))


def trace_events(traces: DataFrame, key: str = "run") -> DataFrame:
    """(key, seq, event, func, module, line, depth, arg_types): one row an event, in order."""
    return traces.select(key, F.posexplode("events").alias("seq", "e")).select(key, F.col("seq").cast("long").alias("seq"), "e.*")


def coverage(reports: DataFrame, key: str = "run", report: str = "json") -> DataFrame:
    """(key, path, executed_lines, missing_lines, excluded_lines) of coverage reports."""
    files = F.from_json(report, schemas.COVERAGE)["files"]
    empty = lambda c: F.coalesce(c, F.array().cast("array<int>"))
    rows = reports.select(key, F.explode(files).alias("path", "v"))
    return rows.select(key, "path", *[empty(F.col(f"v.{c}")).alias(c) for c in ("executed_lines", "missing_lines", "excluded_lines")])


def lint_severity(code: Column) -> Column:
    """E is an error; W, F, N, D, C, B and S are warnings; the rest are notes."""
    first = F.substring(code, 1, 1)
    return F.when(first == "E", "error").when(first.isin("W", "F", "N", "D", "C", "B", "S"), "warning").otherwise("note")


LINT_LINE = r"^(.+?):(\d+):(\d+):\s+([A-Z]+\d+)\s+(.*)$"


def lint(outputs: DataFrame, key: str = "run", output: str = "stdout") -> DataFrame:
    """(key, file, line, column, code, message, severity) of a linter's JSON, or of its text where it is no JSON."""
    parsed = F.from_json(output, schemas.LINT)
    from_text = F.transform(
        F.filter(F.split(F.coalesce(output, F.lit("")), "\n"), lambda s: s.rlike(LINT_LINE)),
        lambda s: F.struct(F.regexp_extract(s, LINT_LINE, 1).alias("filename"), F.struct(F.regexp_extract(s, LINT_LINE, 2).cast("int").alias("row"), F.regexp_extract(s, LINT_LINE, 3).cast("int").alias("column")).alias("location"), F.regexp_extract(s, LINT_LINE, 4).alias("code"), F.regexp_extract(s, LINT_LINE, 5).alias("message")),
    )
    is_json = F.trim(output).startswith("[")
    rows = outputs.select(key, F.explode(F.when(is_json, parsed).otherwise(from_text)).alias("i"))
    return rows.select(key, F.col("i.filename").alias("file"), F.col("i.location.row").alias("line"), F.col("i.location.column").alias("column"), F.col("i.code").alias("code"), F.col("i.message").alias("message"), lint_severity(F.col("i.code")).alias("severity"))


TYPE_LINE = r"^(.+?):(\d+):(?:(\d+):)? (error|warning|note): (.*?)(?:\s+\[([a-z0-9-]+)\])?$"


def type_check(outputs: DataFrame, key: str = "run", output: str = "stdout") -> DataFrame:
    """(key, file, line, column, severity, message, code) of a type checker's lines."""
    rows = outputs.select(key, F.explode(F.split(F.coalesce(output, F.lit("")), "\n")).alias("text")).filter(F.col("text").rlike(TYPE_LINE))
    part = lambda i: F.regexp_extract("text", TYPE_LINE, i)
    return rows.select(key, part(1).alias("file"), part(2).cast("int").alias("line"), F.when(part(3) != "", part(3)).cast("int").alias("column"), part(4).alias("severity"), part(5).alias("message"), F.when(part(6) != "", part(6)).alias("code"))


def test_summary(outputs: DataFrame, key: str = "run", output: str = "stdout") -> DataFrame:
    """(key, passed, failed, skipped, errors, total, duration, all_passed) of a test run; a run without tests has not passed."""
    count = lambda word: F.coalesce(F.expr(f"try_cast(nullif(regexp_extract({output}, '([0-9]+) {word}', 1), '') as int)"), F.lit(0))
    seconds = F.regexp_extract(output, r" in ([0-9.]+)s", 1)
    rows = outputs.select(key, count("passed").alias("passed"), count("failed").alias("failed"), count("skipped").alias("skipped"), count("error").alias("errors"), F.coalesce(F.when(seconds != "", seconds).cast("double"), F.lit(0.0)).alias("duration"))
    total = F.col("passed") + F.col("failed") + F.col("skipped") + F.col("errors")
    return rows.withColumn("total", total).withColumn("all_passed", (F.col("failed") == 0) & (F.col("errors") == 0) & (F.col("passed") > 0))


TEST_LINE = r"(?m)^(\S+\.py)::(\S+)\s+(PASSED|FAILED|SKIPPED|ERROR)"


def test_results(outputs: DataFrame, key: str = "run", output: str = "stdout") -> DataFrame:
    """(key, file, test, status): one row for each test that a verbose run names."""
    rows = outputs.select(key, F.explode(F.split(F.coalesce(output, F.lit("")), "\n")).alias("text")).filter(F.col("text").rlike(TEST_LINE))
    return rows.select(key, *[F.regexp_extract("text", TEST_LINE, i).alias(c) for i, c in ((1, "file"), (2, "test"), (3, "status"))])
