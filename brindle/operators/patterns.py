"""Pattern drift: what similar symbols of the repository do, and how a changed symbol differs from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions.structure import structural_features

MIN_SCORE, MIN_MISMATCH, ERROR_AT = 0.45, 0.20, 0.40
SIBLING_SCORE, SIBLINGS, CANDIDATES = 0.58, 8, 5
#: Beginnings of helpers' names.
HELPERS = ("validate_", "sanitize_", "parse_", "format_")


def siblings(changed: DataFrame, symbols: DataFrame, limit: int = SIBLINGS) -> DataFrame:
    """(path, symbol, name, content, score): up to ``limit`` other symbols of the changed symbol's file, by name, at a constant score.

    Of a file, the first ``limit + 1`` names and ``limit`` symbols of each are all that any of its symbols can need. They are
    cut before the join, so that a file of many symbols never meets itself.
    """
    names = F.dense_rank().over(W.partitionBy("path").orderBy("other"))
    same = F.row_number().over(W.partitionBy("path", "other").orderBy("content"))
    other = symbols.select("path", F.col("name").alias("other"), "content").withColumn("names", names).filter(F.col("names") <= limit + 1).withColumn("same", same).filter(F.col("same") <= limit)
    rows = changed.select("path", F.col("name").alias("symbol")).distinct().join(other.drop("names", "same"), "path").filter(F.col("symbol") != F.col("other"))
    rank = F.row_number().over(W.partitionBy("path", "symbol").orderBy("other", "content"))
    return rows.withColumn("n", rank).filter(F.col("n") <= limit).select("path", "symbol", F.col("other").alias("name"), "content", F.lit(SIBLING_SCORE).alias("score"))


def candidates(*sources: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """The ``limit`` best candidates (path, symbol, name, content, score) of each changed symbol with a score of ``MIN_SCORE``; of one name the best."""
    every = sources[0]
    for s in sources[1:]:
        every = every.unionByName(s)
    best = every.filter((F.col("score") >= MIN_SCORE) & (F.col("name") != F.col("symbol"))).groupBy("path", "symbol", "name").agg(F.max_by(F.struct("content", "score"), "score").alias("b"))
    rank = F.row_number().over(W.partitionBy("path", "symbol").orderBy(F.desc("b.score"), "name"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= limit).select("path", "symbol", "name", "b.content", "b.score", "rank")


def _most_frequent(rows: Column, value: str) -> Column:
    """The most frequent value in a group's rows, which stand by rank; of equally frequent ones that seen first."""
    values = F.transform(rows, lambda r: r["f"][value])
    times = F.transform(F.array_distinct(values), lambda v: F.struct(F.size(F.filter(values, lambda w: w == v)).alias("n"), (-F.array_position(values, v)).alias("first"), v.alias("v")))
    return F.array_max(times)["v"]


def _common(rows: Column, value: str) -> Column:
    """Up to eight names that two of a group's rows hold, in the order of the first rows that do; in one row by name."""
    every = F.array_distinct(F.flatten(F.transform(rows, lambda r: F.array_sort(r["f"][value]))))
    return F.slice(F.filter(every, lambda v: F.size(F.filter(rows, lambda r: F.array_contains(r["f"][value], v))) >= 2), 1, 8)


def conventions(found: DataFrame) -> DataFrame:
    """(path, symbol, return_style, has_try_except, raises, parameter_count, common_calls, common_imports, score, examples) of candidates.

    Helpers count only where there are no other candidates. A call or import is common if two candidates have it. The few candidates
    of a symbol are one row, and their code is parsed once.
    """
    helper = F.lower("name").rlike("^(" + "|".join(HELPERS) + ")")
    row = F.struct("rank", "name", helper.alias("helper"), "score", structural_features(F.col("content")).alias("f"))
    groups = found.groupBy("path", "symbol").agg(F.sort_array(F.collect_list(row)).alias("all"))
    rows = F.when(F.exists("all", lambda r: ~r["helper"]), F.filter("all", lambda r: ~r["helper"])).otherwise(F.col("all"))
    # exploding a list of one keeps the optimizer from filtering the rows for each use of them
    groups = groups.select("path", "symbol", "all", F.explode(F.array(rows)).alias("rows"))
    kinds = [_most_frequent(F.col("rows"), c).alias(c) for c in ("return_style", "has_try_except", "raises", "parameter_count")]
    common = [_common(F.col("rows"), c).alias(f"common_{c}") for c in ("calls", "imports")]
    score = F.array_max(F.transform("all", lambda r: r["score"]))
    return groups.select("path", "symbol", score.alias("score"), F.transform("all", lambda r: r["name"]).alias("examples"), *kinds, *common)


def compare(changed: DataFrame, convention: DataFrame) -> DataFrame:
    """(path, symbol, mismatch, confidence, findings array<struct>) of changed symbols (path, name, content) against their conventions.

    Mismatch is the share of the points that differ: return style, exception flow, missing common calls (if there are any)
    and two or more parameters apart. Below ``MIN_SCORE`` or ``MIN_MISMATCH`` there are no findings.
    """
    own = changed.select("path", F.col("name").alias("symbol"), structural_features(F.col("content")).alias("f"))
    rows = own.join(convention, ["path", "symbol"])
    missing = F.array_sort(F.array_except("common_calls", "f.calls"))
    has_calls = F.size("common_calls") > 0
    checks = [
        ("return-style-drift", F.col("f.return_style") != F.col("return_style"), F.concat(F.col("symbol"), F.lit(" returns "), F.col("f.return_style"), F.lit(", similar symbols return "), F.col("return_style"))),
        ("exception-flow-drift", F.col("f.has_try_except") != F.col("has_try_except"), F.lit("exception handling differs from similar symbols")),
        ("helper-call-drift", has_calls & (F.size(missing) > 0), F.concat(F.lit("missing calls of similar symbols: "), F.array_join(F.slice(missing, 1, 4), ", "))),
        ("signature-shape-drift", F.abs(F.col("f.parameter_count") - F.col("parameter_count")) >= 2, F.concat(F.col("f.parameter_count").cast("string"), F.lit(" parameters, similar symbols have "), F.col("parameter_count").cast("string"))),
    ]
    points = sum((c.cast("int") for _, c, _ in checks[1:]), checks[0][1].cast("int"))
    rows = rows.withColumn("mismatch", points / (3 + has_calls.cast("int"))).withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")) * F.col("mismatch")))
    severe = F.col("confidence") >= ERROR_AT

    def finding(pattern: str, when, reason):
        strict = severe if pattern in ("return-style-drift", "exception-flow-drift") else F.lit(False)
        return F.when(when, F.struct(F.when(strict, "error").otherwise("warning").alias("severity"), F.col("path").alias("affected_file"), F.col("symbol").alias("affected_symbol"), reason.alias("reason"), F.lit(pattern).alias("matched_pattern"), F.lit("Compare with the examples of the repository.").alias("suggested_fix"), F.when(strict, "failed").otherwise("warning").alias("validation_status")))

    found = F.array_compact(F.array(*[finding(*c) for c in checks]))
    open_ = (F.col("score") >= MIN_SCORE) & (F.col("mismatch") >= MIN_MISMATCH)
    return rows.select("path", "symbol", "mismatch", "confidence", F.when(open_, found).otherwise(F.filter(found, lambda _: F.lit(False))).alias("findings"))


def detect(changed: DataFrame, symbols: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """Findings of changed symbols (path, name, content) against siblings among ``symbols`` and ``similar`` candidates, for all symbols at once."""
    found = candidates(*([similar] if similar is not None else []), siblings(changed, symbols))
    return compare(changed, conventions(found)).select(F.inline("findings"))
