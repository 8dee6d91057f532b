"""Unified diffs as hunks with changed line numbers, and the symbols that they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.operators.lines import inside

HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def diff_lines(diffs: DataFrame, key: str = "path", patch: str = "patch") -> DataFrame:
    """(key, n, hunk, mark, old_line, new_line, text): the lines of each hunk, numbered in the old and the new file.

    Line numbers are running counts within a hunk, so that nothing is replayed in order on one machine.
    """
    rows = diffs.select(key, F.posexplode(F.split(F.coalesce(patch, F.lit("")), "\n")).alias("n", "text"))
    rows = rows.withColumn("header", F.when(F.col("text").rlike(HEADER), F.col("text")))
    over = W.partitionBy(key).orderBy("n")
    rows = rows.withColumn("hunk", F.count("header").over(over)).filter("hunk > 0")
    inside = W.partitionBy(key, "hunk").orderBy("n")
    rows = rows.withColumn("head", F.first("header", ignorenulls=True).over(inside)).withColumn("mark", F.when(F.col("header").isNull(), F.substring("text", 1, 1)))
    number = lambda i: F.regexp_extract("head", HEADER, i).cast("int")
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    count = lambda marks: F.coalesce(F.sum(F.col("mark").isin(*marks).cast("int")).over(before), F.lit(0))
    # the header itself is the first row of its hunk, so that counts before a line hold only lines of the hunk
    rows = rows.withColumn("old_line", number(1) + count([" ", "-"])).withColumn("new_line", number(3) + count([" ", "+"]))
    return rows.filter("mark in (' ', '+', '-')").filter(~F.col("text").rlike(r"^(--- |\+\+\+ )")).select(key, "n", "hunk", "head", "mark", F.col("old_line").cast("int").alias("old_line"), F.col("new_line").cast("int").alias("new_line"), F.expr("substr(text, 2)").alias("text"))


def parse_hunks(diffs: DataFrame, key: str = "path", patch: str = "patch") -> DataFrame:
    """One row a hunk: header, ranges, changed lines of both sides.

    A patch is parsed within its row: a changed line's number is its place among those lines of the hunk that its side
    has, so that no line becomes a row, and nothing is sorted or shuffled. Rows of one key are patches of their own.
    """
    split = diffs.select(key, F.explode(F.array(F.split(F.coalesce(patch, F.lit("")), "\n"))).alias("lines"))
    places = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(HEADER), i)), F.isnotnull)
    found = split.select(key, "lines", F.explode(F.array(places)).alias("heads"))
    parts = F.transform("heads", lambda h, i: F.slice("lines", h + 1, F.coalesce(F.get("heads", i + 1), F.size("lines")) - h))
    rows = found.select(key, F.posexplode(parts).alias("n", "lines")).select(key, (F.col("n") + 1).cast("long").alias("hunk"), F.col("lines")[0].alias("head"), "lines")
    size = lambda i: F.when(F.regexp_extract("head", HEADER, i) == "", 1).otherwise(F.regexp_extract("head", HEADER, i).cast("int"))
    start = lambda i: F.regexp_extract("head", HEADER, i).cast("int")
    marked = lambda x, *marks: F.substring(x, 1, 1).isin(*marks)
    # lines that look like a file's header are counted, but are no change
    own = lambda x: ~x.rlike(r"^(--- |\+\+\+ )")

    def changed(mark: str, first: str) -> Column:
        side = F.filter("lines", lambda x: marked(x, " ", mark))
        return F.filter(F.transform(side, lambda x, i: F.when(marked(x, mark) & own(x), F.col(first) + i)), F.isnotnull)

    rows = rows.filter(F.exists("lines", lambda x: marked(x, " ", "+", "-") & own(x))).withColumns({"old": start(1), "new": start(3)})
    hunks = rows.select(key, "hunk", "head", changed("-", "old").alias("changedOldLines"), changed("+", "new").alias("changedNewLines"))
    return hunks.select(key, "hunk", F.col("head").alias("header"), start(1).alias("oldStart"), size(2).alias("oldLines"), start(3).alias("newStart"), size(4).alias("newLines"), "changedOldLines", "changedNewLines")


def changed_symbols(hunks: DataFrame, new_symbols: DataFrame, old_symbols: DataFrame | None = None, key: str = "path") -> DataFrame:
    """(key, name, type, start_line, end_line, changedLines): symbols that a changed line falls into.

    New line numbers meet new symbols, old line numbers the old ones, so that deletions count. Symbols meet the blocks of
    lines that they cover, so that a file is never one row or one task.
    """

    def touched(side: str, symbols: DataFrame) -> DataFrame:
        changed = hunks.select(F.col(key).alias("key"), F.explode(side).alias("line"))
        return inside(symbols.select(key, "name", "type", "start_line", "end_line"), changed, key, "changed")

    rows = touched("changedNewLines", new_symbols)
    if old_symbols is not None:
        rows = rows.unionByName(touched("changedOldLines", old_symbols))
    return rows.groupBy(key, "name", "type").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.sort_array(F.collect_set("changed")).alias("changedLines"))
