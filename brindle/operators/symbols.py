"""Symbol snapshots: differences of two versions, their summary and impact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("added", "removed", "modified")


def snapshot(extracted: DataFrame) -> DataFrame:
    """(path, name, symbol_type, start_line, end_line, signature, docstring) of extracted files."""
    return extracted.select("path", F.inline("symbols"))


def diff(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("path", "name")) -> DataFrame:
    """(keys, symbol_type, change_type) of symbols that were added, removed or modified: another signature or docstring.

    Moves and changes of bodies alone are no changes.
    """
    keep = ["symbol_type", "signature", "docstring"]
    a = old.select(*keys, F.struct(*keep).alias("old"))
    b = new.select(*keys, F.struct(*keep).alias("new"))
    same = F.col("old.signature").eqNullSafe(F.col("new.signature")) & F.col("old.docstring").eqNullSafe(F.col("new.docstring"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~same, "modified")
    both = a.join(b, list(keys), "full_outer").withColumn("change_type", kind).filter("change_type is not null")
    return both.select(*keys, F.coalesce("new.symbol_type", "old.symbol_type").alias("symbol_type"), "change_type", F.col("old.signature").alias("old_signature"), F.col("new.signature").alias("new_signature"))


def summary(changes: DataFrame, *by: str) -> DataFrame:
    """Counts of changes by kind, and by kind for functions and classes, for each group of ``by`` or in all."""
    count = lambda kind, symbol=None: F.count_if((F.col("change_type") == kind) & (F.lit(True) if symbol is None else F.col("symbol_type") == symbol))
    columns = [count(k).alias(k) for k in KINDS] + [count(k, s).alias(f"{k}_{name}") for s, name in (("function", "functions"), ("class", "classes")) for k in KINDS]
    return changes.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *columns)


def impact(summaries: DataFrame) -> DataFrame:
    """``summaries`` with impact_level (none, low up to 2 changes, medium up to 5, high) and flags for removals and changed signatures."""
    level = F.when(F.col("total") == 0, "none").when(F.col("total") <= 2, "low").when(F.col("total") <= 5, "medium").otherwise("high")
    return summaries.withColumn("impact_level", level).withColumn("has_removals", F.col("removed") > 0).withColumn("has_modifications", F.col("modified") > 0)


def symbol(extracted: DataFrame, names: DataFrame) -> DataFrame:
    """The deep analysis of symbols ``names(path, symbol_name)``: one or many at once."""
    return extracted.select("path", F.inline("deep")).join(names.select("path", "symbol_name").distinct(), ["path", "symbol_name"], "left_semi")
