"""Test coverage: by file, by function, and the mapping of tests to sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import paths
from brindle.operators import lines


def percent(covered, missing):
    return F.coalesce(F.round(F.try_divide(covered, covered + missing) * 100, 2), F.lit(0.0))


def by_file(coverage: DataFrame) -> DataFrame:
    """(path, covered, missing, percent); 0 for a file without lines."""
    rows = coverage.select("path", F.size("executed_lines").cast("long").alias("covered"), F.size("missing_lines").cast("long").alias("missing"))
    return rows.withColumn("percent", percent(F.col("covered"), F.col("missing")))


def overall(coverage: DataFrame) -> DataFrame:
    row = by_file(coverage).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("covered"), F.lit(0)).alias("covered"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"))
    return row.withColumn("percent", percent(F.col("covered"), F.col("missing")))


def _key(match: str, path: Column) -> Column:
    return paths.basename(path) if match == "basename" else paths.normalized(path)


def _lines(coverage: DataFrame, column: str, match: str) -> DataFrame:
    return coverage.select(_key(match, F.col("path")).alias("key"), F.explode(column).alias("line"))


def covered_functions(functions: DataFrame, coverage: DataFrame, match: str = "basename") -> DataFrame:
    """Functions (path, name, start_line, end_line) with an executed line.

    ``match="basename"`` takes files of equal base name for the same, ``"path"`` needs the whole path. A function looks up
    the block of lines that it starts in, so that a name that many files have, such as ``__init__.py``, is not one task.
    """
    return lines.holding(functions, _lines(coverage, "executed_lines", match), _key(match, F.col("path")))


def function_coverage(functions: DataFrame, coverage: DataFrame, match: str = "basename") -> DataFrame:
    """``functions`` with their executed lines (covered), lines that no report executes (missing) and percent; 0 without lines."""
    executed = _lines(coverage, "executed_lines", match).distinct()
    missing = _lines(coverage, "missing_lines", match).distinct().join(executed, ["key", "line"], "left_anti")
    rows = lines.counted(functions, executed, _key(match, F.col("path")), "covered")
    rows = lines.counted(rows, missing, _key(match, F.col("path")), "missing")
    return rows.withColumn("percent", percent(F.col("covered"), F.col("missing")))


SUITE = "suite"


def coverage_edges(functions: DataFrame, tests: DataFrame) -> DataFrame:
    """(src, dst, type): every covered function (id) is COVERED_BY the suite, which HAS_TEST every test (id).

    Reports name no single test, so that each function is covered by all of them: that is functions plus tests rows.
    """
    covered = functions.select(F.col("id").alias("src"), F.lit(SUITE).alias("dst"), F.lit("COVERED_BY").alias("type"))
    return covered.unionByName(tests.select(F.lit(SUITE).alias("src"), F.col("id").alias("dst"), F.lit("HAS_TEST").alias("type"))).distinct()


def expanded_coverage(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(src, dst, COVERED_BY) of the functions ``wanted(id)`` with every test, through the suite: for the few that are asked for."""
    asked = edges.filter("type = 'COVERED_BY'").join(wanted.select(F.col("id").alias("src")), "src", "left_semi").select("src", F.col("dst").alias("suite"))
    tests = edges.filter("type = 'HAS_TEST'").select(F.col("src").alias("suite"), "dst")
    return asked.join(tests, "suite").select("src", "dst", F.lit("COVERED_BY").alias("type"))


def coverage_edges_by_name(mapping: DataFrame, functions: DataFrame, tests: DataFrame) -> DataFrame:
    """(src, dst, COVERED_BY) of pairs ``mapping(function, test)`` of names, among the nodes ``functions(id, name)`` and ``tests(id, name)``."""
    pairs = mapping.select("function", "test").distinct()
    found = pairs.join(functions.select(F.col("id").alias("src"), F.col("name").alias("function")), "function").join(tests.select(F.col("id").alias("dst"), F.col("name").alias("test")), "test")
    return found.select("src", "dst", F.lit("COVERED_BY").alias("type")).distinct()


def test_imports(extracted: DataFrame, match: str = "first_segment") -> DataFrame:
    """(test, module): what each test file imports: the first segment of modules, or the whole module."""
    rows = extracted.filter(paths.is_test(F.col("path"))).select(F.col("path").alias("test"), F.explode("imports").alias("i")).filter("i.module is not null")
    module = F.split_part("i.module", F.lit("."), F.lit(1)) if match == "first_segment" else F.col("i.module")
    return rows.select("test", module.alias("module")).distinct()


def tested_sources(files: DataFrame, imports: DataFrame, match: str = "first_segment") -> DataFrame:
    """(test, source): source files (path) that a test imports, by file stem or by whole dotted path."""
    module = paths.stem(F.col("path")) if match == "first_segment" else F.replace(F.regexp_replace("path", r"\.py$", ""), F.lit("/"), F.lit("."))
    sources = files.filter(paths.is_source(F.col("path"))).select(F.col("path").alias("source"), module.alias("module"))
    return imports.join(sources, "module").select("test", "source").distinct()


def uncovered_sources(files: DataFrame, mapping: DataFrame) -> DataFrame:
    """(path): source files that no test maps to."""
    sources = files.filter(paths.is_source(F.col("path"))).select("path").distinct()
    return sources.join(mapping.select(F.col("source").alias("path")), "path", "left_anti")


def mapping_report(files: DataFrame, mapping: DataFrame) -> DataFrame:
    """(tests, sources, covered, uncovered, percent)."""
    counts = files.select("path").distinct().agg(F.count_if(paths.is_test(F.col("path"))).alias("tests"), F.count_if(paths.is_source(F.col("path"))).alias("sources"))
    row = counts.join(mapping.agg(F.countDistinct("source").alias("covered")))
    return row.withColumn("uncovered", F.col("sources") - F.col("covered")).withColumn("percent", percent(F.col("covered"), F.col("uncovered")))
