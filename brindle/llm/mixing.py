"""Mixing sources to target weights by Poisson replication.

The mean number of copies of a row of source s is ``rate_s = target rows * weight_s / rows_s``. Each row draws its number
of copies by inverting the Poisson distribution at a uniform number hashed from seed and key, so that a rerun of a lost
task draws the same; the row is exploded by it, and copies are shuffled globally by a hash of seed, key and copy.

The one aggregation counts rows by source and combines on the map side, so that a hot source is one row per task. Rates
are joined by a broadcast only while there are at most ``MAX_BROADCAST`` sources; beyond that by a salted join.

Defined results: a null source is a source of its own; a null key draws as the text "null"; repeated rows draw alike and
are each replicated; an empty table gives an empty result; a source without a weight given is left out (weight 0);
extra columns pass through, but for those named as ``copy`` and ``shuffle_key``, which are made anew.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, stored

#: Weight of a source with n rows when none are given: n ** TEMPER.
TEMPER = 0.5
#: Sources up to which the table of rates (under 100 bytes a row) is broadcast; salts beyond.
MAX_BROADCAST, SALTS = 50_000, 32
#: A mean above this is the sum of several Poisson draws, so that exp(-mean) stays far from underflow.
MAX_MEAN = 64.0


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of ``parts`` joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def inverted(u: Column, cdf: Column) -> Column:
    """The smallest k with u < cdf[k]."""
    return F.size(F.filter(cdf, lambda c: c <= u))


def distribution(mean: Column) -> Column:
    """The cumulative Poisson probabilities from 0 up to where the rest is below the hash's resolution."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("out"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.array_append(acc["out"], F.element_at(acc["out"], -1) + p).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["out"]


def rates(df: DataFrame, source: str = "source", weights: Mapping[str, float] | None = None, scale: float = 1.0) -> DataFrame:
    """(source, n, rate): rows of each source and mean copies of each of its rows, for ``scale`` times the rows in all."""
    counts = df.groupBy(F.col(source).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(TEMPER))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    counts = stored(counts.withColumn("weight", weight), "mixing-counts")
    total = counts.agg(F.sum("n").alias("rows"), F.sum("weight").alias("weights")).first()  # two numbers
    share = F.col("weight") / F.lit(total.weights or 1.0) / F.col("n")
    return counts.select("source", "n", (F.lit(float(total.rows or 0) * scale) * share).alias("rate"))


def mix(df: DataFrame, source: str = "source", key: str = "doc_id", weights: Mapping[str, float] | None = None, scale: float = 1.0, seed: int = 17, copy: str = "copy", shuffle_key: str = "shuffle_key") -> DataFrame:
    """The rows of ``df`` replicated to the target weights in a global random order, with the columns ``copy``, from 1, and ``shuffle_key``."""
    names = [c for c in df.columns if c not in (copy, shuffle_key)]
    means = rates(df, source, weights, scale).withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_MEAN)).cast("int"))
    means = means.select("source", "draws", distribution(F.col("rate") / F.col("draws")).alias("cdf"))
    means = stored(means, "mixing-means")
    plain, columns = numbered(df.select(*names))
    rows = plain.withColumns({"own": F.coalesce(F.col(columns[key]).cast("string"), F.lit("null")), "from_source": F.col(columns[source]).cast("string")})
    same = F.col("from_source").eqNullSafe(F.col("source"))
    if means.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        joined = rows.join(F.broadcast(means), same)
    else:
        salted = means.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("mine", F.pmod(F.xxhash64("own"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("mine") == F.col("salt")))
    draws = F.transform(F.sequence(F.lit(1), F.col("draws")), lambda i: inverted(uniform(F.lit(str(seed)), F.col("own"), i.cast("string")), F.col("cdf")))
    copies = F.aggregate(draws, F.lit(0), lambda a, k: a + k)
    counted = joined.select(*columns.values(), "own", copies.alias("copies")).filter("copies > 0")
    dealt = counted.withColumn("number", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "own", F.col("number").cast("string")))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.select(*[F.col(c).alias(name) for name, c in columns.items()], F.col("number").alias(copy), order.alias(shuffle_key)).repartition(parts, shuffle_key).sortWithinPartitions(shuffle_key)
