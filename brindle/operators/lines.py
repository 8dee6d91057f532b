"""Ranges of lines against sets of lines, by blocks of 64 lines.

A block is one row of bits, however many reports name its lines. Blocks up to the last one are dense and carry what lies
beside them: how many lines come before, and the first line behind. So "any in the range" is one look-up, and "how many"
two, of rows that are keyed by name *and* block. A name that very many ranges share, such as ``__init__.py``, is dealt to
``SALTS`` tasks as well, since blocks are few rows to repeat.

Defined results: null and negative lines are left out, lines that repeat count once, a range that ends before it starts
or has a null end holds nothing, and null names meet nothing. Rows grow with the highest line of a name over 64.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tasks that the ranges of one name and block are dealt to.
SALTS = 8
_BITS = 64


def _block(line: Column) -> Column:
    return F.shiftright(line.cast("long"), 6)


def _place(line: Column) -> Column:
    return line.cast("long").bitwiseAND(_BITS - 1).cast("int")


def _between(bits: str, low: Column, high: Column) -> Column:
    """Those of the bits from place ``low`` to place ``high``, as a number that has as many bits set."""
    return F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.col(bits), low), low + (_BITS - 1) - high)


def blocks(lines: DataFrame, key: str = "key", line: str = "line") -> DataFrame:
    """(key, block, bits, before, next, total): each block of ``lines(key, line)`` up to the last of its key, with no gap.

    ``before`` counts the lines of lower blocks, ``next`` is the first line of higher ones (null: none), ``total`` counts all.
    """
    known = lines.filter(F.col(key).isNotNull() & (F.col(line) >= 0)).select(F.col(key).alias("key"), _block(F.col(line)).alias("block"), F.col(line).cast("long").alias("line"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), _place(F.col("line")))
    found = known.groupBy("key", "block").agg(F.bit_or(bit).alias("bits"), F.min("line").alias("first"))
    of, order = W.partitionBy("key"), W.partitionBy("key").orderBy("block")  # one row a block
    count = F.bit_count("bits").cast("long")
    found = found.withColumns({
        "before": F.coalesce(F.sum(count).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "total": F.sum(count).over(of),
        "next": F.lead("first").over(order),
        "from": F.coalesce(F.lag("block").over(order) + 1, F.lit(0)),
    })
    dense = found.withColumn("at", F.explode(F.sequence("from", "block")))
    full = F.col("at") == F.col("block")
    return dense.select("key", F.col("at").alias("block"), F.when(full, F.col("bits")).otherwise(0).alias("bits"), "before", F.when(full, F.col("next")).otherwise(F.col("first")).alias("next"), "total")


def _dealt(table: DataFrame) -> DataFrame:
    return table.withColumn("__salt", F.explode(F.array(*map(F.lit, range(SALTS)))))


def _salted(ranges: DataFrame) -> DataFrame:
    return ranges.withColumn("__salt", F.pmod(F.xxhash64("__low", "__high", *[c for c in ranges.columns if c in ("path", "name")]), F.lit(SALTS)).cast("int"))


def _ranges(ranges: DataFrame, key: Column, start: str, end: str) -> DataFrame:
    rows = ranges.withColumns({"__key": key, "__low": F.greatest(F.col(start).cast("long"), F.lit(0)), "__high": F.col(end).cast("long")})
    return _salted(rows.withColumn("__low", F.when(F.col(start).isNotNull(), F.col("__low"))))


def holding(ranges: DataFrame, lines: DataFrame, key: Column, start: str = "start_line", end: str = "end_line") -> DataFrame:
    """``ranges`` that hold a line of ``lines(key, line)``: one look-up, of the block that the range starts in."""
    table = _dealt(blocks(lines).select(F.col("key").alias("__key"), F.col("block").alias("__block"), "bits", "next")).withColumnsRenamed({"bits": "__bits", "next": "__next"})
    asked = _ranges(ranges, key, start, end).filter("__high >= __low").withColumn("__block", _block(F.col("__low")))
    last = F.least(F.col("__high") - F.col("__block") * _BITS, F.lit(_BITS - 1)).cast("int")
    hit = (_between("__bits", _place(F.col("__low")), last) != 0) | F.coalesce(F.col("__next") <= F.col("__high"), F.lit(False))
    return asked.join(table, ["__key", "__block", "__salt"]).filter(hit).select(*[ranges[c] for c in ranges.columns])


def counted(ranges: DataFrame, lines: DataFrame, key: Column, name: str, start: str = "start_line", end: str = "end_line") -> DataFrame:
    """``ranges`` with the number ``name`` of lines of ``lines(key, line)`` that each holds: the difference of two ranks, each a look-up."""
    table = _dealt(blocks(lines).select("key", "block", "bits", "before", "total"))
    rank = lambda bits, before, line: before + F.bit_count(_between(bits, F.lit(0), _place(line)))

    def looked_up(rows: DataFrame, line: str, tag: str) -> DataFrame:
        own = {"key": "__key", "block": "__block", "bits": f"__bits{tag}", "before": f"__before{tag}", "total": f"__total{tag}"}
        at = rows.withColumn("__block", _block(F.col(line)))
        return at.join(table.withColumnsRenamed(own), ["__key", "__block", "__salt"], "left").drop("__block")

    rows = _ranges(ranges, key, start, end).withColumn("__under", F.col("__low") - 1)
    rows = looked_up(looked_up(rows, "__low", "1"), "__high", "2")
    # a start beyond the last block has nothing behind it; an end beyond it has all lines before it
    upto = F.coalesce(rank("__bits2", F.col("__before2"), F.col("__high")), F.col("__total1"))
    first = F.col("__before1") + F.when(_place(F.col("__low")) > 0, F.bit_count(_between("__bits1", F.lit(0), _place(F.col("__under"))))).otherwise(0)
    held = F.when(F.col("__high") >= F.col("__low"), F.coalesce(upto - first, F.lit(0))).otherwise(0)
    return rows.select(*[F.col(c) for c in ranges.columns], held.cast("long").alias(name))


def inside(ranges: DataFrame, lines: DataFrame, key: str, name: str, start: str = "start_line", end: str = "end_line") -> DataFrame:
    """A row for each of ``ranges`` and each line of ``lines(key, line)`` that it holds, as ``name``: ranges meet the blocks that they cover.

    A block is one number and is not repeated. Both sides are shuffled for the join alone, so that adaptive execution splits the ranges of a name that very many share.
    """
    known = lines.filter("key is not null and line >= 0").select(F.col("key").alias("__key"), _block(F.col("line")).alias("__at"), F.col("line").cast("long").alias("line"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), _place(F.col("line")))
    # a further key of the join keeps the counted blocks from being joined where they were counted
    turn = lambda key, block: F.pmod(F.xxhash64(key, block), F.lit(SALTS))
    table = known.groupBy("__key", "__at").agg(F.bit_or(bit).alias("__bits")).withColumn("__turn_at", turn("__key", "__at"))
    low, high = F.greatest(F.col(start).cast("long"), F.lit(0)), F.col(end).cast("long")
    covered = F.explode(F.sequence(_block(low), _block(high))).alias("__block")
    asked = ranges.filter(F.col(key).isNotNull() & F.col(start).isNotNull() & (high >= low)).select(*ranges.columns, covered).withColumn("__turn", turn(key, "__block"))
    met = asked.join(table, [F.col(key) == F.col("__key"), F.col("__block") == F.col("__at"), F.col("__turn") == F.col("__turn_at")])
    first, last = F.greatest(low, F.col("__block") * _BITS), F.least(high, F.col("__block") * _BITS + (_BITS - 1))
    met = met.withColumns({"__low": first, "__high": last}).filter(_between("__bits", _place(F.col("__low")), _place(F.col("__high"))) != 0)
    held = F.filter(F.sequence("__low", "__high"), lambda n: F.getbit("__bits", n.bitwiseAND(_BITS - 1).cast("int")) == 1)
    return met.select(*[F.col(c) for c in ranges.columns], F.explode(held.cast(f"array<{lines.schema['line'].dataType.simpleString()}>")).alias(name))
