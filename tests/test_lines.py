"""Ranges of lines against sets of lines, by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import coverage, lines
from brindle.sources import hunks

RANGES = "path string, name int, start_line int, end_line int"


def made(seed, names, n):
    rng = random.Random(seed)
    ends = [(rng.choice(names), i, s := rng.choice([0, 1, 63, 64, 127, 128, rng.randrange(900)]), s + rng.choice([-3, 0, 1, 63, 64, 65, 400])) for i in range(n)]
    ends += [("a", n, None, 5), ("a", n + 1, 5, None), (None, n + 2, 0, 900), ("gone", n + 3, 0, 900), ("a", n + 4, -9, 3)]
    said = [(rng.choice(names), rng.choice([0, 63, 64, 511, rng.randrange(700)])) for _ in range(60)]
    return ends, said + said[:9] + [(None, 5), ("a", None), ("a", -2)]


@pytest.mark.parametrize("seed, names", [(1, ["a"]), (2, ["a", "b", "c"])])
def test_against_all_pairs(spark, seed, names):
    ends, said = made(seed, names, 120)
    ranges, points = spark.createDataFrame(ends, RANGES), spark.createDataFrame(said, "key string, line int")
    known = {s for s in said if None not in s and s[1] >= 0}
    held = {r[1]: sorted(line for key, line in known if key == r[0] and r[2] is not None and r[3] is not None and r[2] <= line <= r[3]) for r in ends}
    key = F.col("path")
    assert {r.name: r.n for r in lines.counted(ranges, points, key, "n").collect()} == {i: len(v) for i, v in held.items()}
    assert {r.name for r in lines.holding(ranges, points, key).collect()} == {i for i, v in held.items() if v}
    met = lines.inside(ranges, points, "path", "at").collect()
    assert sorted((r.name, r.at) for r in met) == sorted((i, x) for i, v in held.items() for x in v)


def test_one_name_for_all_files_is_many_tasks(spark):
    """Functions of one base name are dealt, and equal functions come out as often as they came in."""
    functions = spark.range(400).select(F.concat(F.lit("p"), "id", F.lit("/__init__.py")).alias("path"), F.lit("f").alias("name"), F.lit(2).alias("start_line"), F.lit(4).alias("end_line"))
    asked = lines._ranges(functions, F.lit("__init__.py"), "start_line", "end_line")
    assert asked.groupBy("__key", "__salt").count().agg(F.max("count")).first()[0] < 100
    report = spark.createDataFrame([("x/__init__.py", [3], [4, 3]), ("y/__init__.py", [70], None)], "path string, executed_lines array<int>, missing_lines array<int>")
    twice = functions.union(functions)
    assert coverage.covered_functions(twice, report).count() == 800
    assert {tuple(r)[4:] for r in coverage.function_coverage(twice, report).collect()} == {(1, 1, 50.0)}
    assert coverage.function_coverage(twice, report, "path").agg(F.sum("covered")).first()[0] == 0


def test_empty(spark):
    ranges, points = spark.createDataFrame([("a", 1, 1, 2)], RANGES), spark.createDataFrame([], "key string, line int")
    assert lines.counted(ranges, points, F.col("path"), "n").first().n == 0 and lines.holding(ranges, points, F.col("path")).count() == 0
    assert lines.inside(ranges.limit(0), points, "path", "at").count() == 0


def test_changed_lines_of_a_file_with_many_symbols(spark, rows):
    found = spark.createDataFrame([("m.py", [5, 64, 65, 200])], "path string, changedNewLines array<int>")
    symbols = spark.createDataFrame([("m.py", i, "function", i, i + 60) for i in range(0, 300, 20)], "path string, name int, type string, start_line int, end_line int")
    expected = [(i, on) for i in range(0, 300, 20) if (on := [n for n in (5, 64, 65, 200) if i <= n <= i + 60])]
    assert sorted((r.name, r.changedLines) for r in hunks.changed_symbols(found, symbols).collect()) == expected
