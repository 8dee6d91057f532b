"""Runtime traces: call pairs, call graph measures, and observed argument types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAIR = ["caller", "callee"]


def is_marker(name: Column) -> Column:
    """Names of the interpreter's own frames, such as <module>."""
    return name.startswith("<")


def call_pairs(events: DataFrame, run: str = "run") -> DataFrame:
    """(caller, callee, n): how often each function returned to each caller.

    The frame below depth d is the last call at depth d - 1 before the return. Calls are sent to their children's depth and
    returns stay at theirs, so that the stack is a ``last`` over (run, depth) in order of events: no replay of the whole run.
    """
    calls = events.filter("event = 'call'").select(run, (F.col("depth") + 1).alias("k"), "seq", F.col("func").alias("parent"), F.lit(None).cast("string").alias("child"))
    returns = events.filter("event = 'return'").select(run, F.col("depth").alias("k"), "seq", F.lit(None).cast("string").alias("parent"), F.col("func").alias("child"))
    order = W.partitionBy(run, "k").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    rows = calls.unionByName(returns).withColumn("caller", F.last("parent", ignorenulls=True).over(order)).filter("child is not null and caller is not null")
    return rows.groupBy("caller", F.col("child").alias("callee")).agg(F.count(F.lit(1)).alias("n"))


def counted_pairs(traces: DataFrame) -> DataFrame:
    """(caller, callee, n) of the call_counts of traces, keys ``a->b``; malformed keys and markers are left out."""
    rows = traces.select(F.explode("call_counts").alias("pair", "n")).withColumn("ends", F.split("pair", "->")).filter(F.size("ends") == 2)
    rows = rows.select(F.trim(F.col("ends")[0]).alias("caller"), F.trim(F.col("ends")[1]).alias("callee"), "n")
    return without_markers(rows).groupBy(*PAIR).agg(F.sum("n").alias("n"))


def without_markers(pairs: DataFrame) -> DataFrame:
    return pairs.filter(~is_marker(F.col("caller")) & ~is_marker(F.col("callee")))


def functions_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("caller").alias("func")).union(pairs.select("callee")).distinct()


def pair_totals(pairs: DataFrame) -> DataFrame:
    """(unique_pairs, functions, invocations)."""
    return pairs.agg(F.count(F.lit(1)).alias("unique_pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("invocations")).join(functions_of(pairs).agg(F.count(F.lit(1)).alias("functions"))).select("unique_pairs", "functions", "invocations")


def most_called(pairs: DataFrame, k: int = 10) -> DataFrame:
    """(func, calls): the ``k`` callees with the most invocations."""
    return pairs.groupBy(F.col("callee").alias("func")).agg(F.sum("n").alias("calls")).orderBy(F.desc("calls"), "func").limit(k)


def most_callers(pairs: DataFrame, k: int = 10) -> DataFrame:
    """(func, callers): the ``k`` callees with the most different callers."""
    return pairs.groupBy(F.col("callee").alias("func")).agg(F.countDistinct("caller").alias("callers")).orderBy(F.desc("callers"), "func").limit(k)


def most_callees(pairs: DataFrame, k: int = 10) -> DataFrame:
    return pairs.groupBy(F.col("caller").alias("func")).agg(F.countDistinct("callee").alias("callees")).orderBy(F.desc("callees"), "func").limit(k)


def degree_averages(pairs: DataFrame) -> DataFrame:
    """(avg_callees, avg_callers): pairs by function, rounded to 2 digits; 0 without functions."""
    total = pairs.agg(F.count(F.lit(1)).alias("pairs")).join(functions_of(pairs).agg(F.count(F.lit(1)).alias("functions")))
    share = F.coalesce(F.round(F.try_divide(F.col("pairs"), F.col("functions")), 2), F.lit(0.0))
    return total.select(share.alias("avg_callees"), share.alias("avg_callers"))


def adjacency(pairs: DataFrame) -> DataFrame:
    """(func, calls_to, called_by, call_frequency): sorted neighbours and counts of each function."""
    out = pairs.groupBy(F.col("caller").alias("func")).agg(F.sort_array(F.collect_set("callee")).alias("calls_to"), F.sort_array(F.collect_list(F.struct("callee", "n"))).alias("f"))
    into = pairs.groupBy(F.col("callee").alias("func")).agg(F.sort_array(F.collect_set("caller")).alias("called_by"))
    none = F.array().cast("array<string>")
    frequency = F.coalesce(F.map_from_entries("f"), F.create_map().cast("map<string,bigint>"))
    return out.join(into, "func", "full_outer").select("func", F.coalesce("calls_to", none).alias("calls_to"), F.coalesce("called_by", none).alias("called_by"), frequency.alias("call_frequency"))


def summary(events: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(total_events, call_events, return_events, max_depth[, unique_pairs])."""
    row = events.agg(F.count(F.lit(1)).alias("total_events"), F.count_if(F.col("event") == "call").alias("call_events"), F.count_if(F.col("event") == "return").alias("return_events"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))
    return row.join(pairs.agg(F.count(F.lit(1)).alias("unique_pairs"))) if pairs is not None else row


def existing_pairs(pairs: DataFrame, functions: DataFrame) -> DataFrame:
    """Pairs with both ends among ``functions(name)``."""
    known = functions.select("name").distinct()
    return pairs.join(known.withColumnRenamed("name", "caller"), "caller", "left_semi").join(known.withColumnRenamed("name", "callee"), "callee", "left_semi").select(*pairs.columns)


def missing_functions(pairs: DataFrame, functions: DataFrame) -> DataFrame:
    """(func): ends of pairs that are not among ``functions(name)``."""
    return functions_of(pairs).join(functions.select(F.col("name").alias("func")), "func", "left_anti")


def callers_known(functions: DataFrame, pairs: DataFrame) -> DataFrame:
    """``functions(name)`` that call something at runtime."""
    return functions.join(pairs.select(F.col("caller").alias("name")), "name", "left_semi")


def argument_types(calls: DataFrame, k: int = 5) -> DataFrame:
    """(func, arg, types, observations): the ``k`` most frequent types of each argument place, and how often any was seen.

    calls: (func, arg_types). Ties by type name.
    """
    seen = calls.select("func", F.posexplode("arg_types").alias("arg", "type")).groupBy("func", "arg", "type").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy("func", "arg"))
    rank = F.row_number().over(W.partitionBy("func", "arg").orderBy(F.desc("n"), "type"))
    best = seen.withColumn("observations", total).withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.groupBy("func", "arg", "observations").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "type", "n"))), lambda s: F.struct(s["type"].alias("type"), s["n"].alias("n"))).alias("types"))


def signatures(calls: DataFrame) -> DataFrame:
    """(func, signature, n) of the argument type tuples seen."""
    shown = F.concat(F.lit("("), F.array_join("arg_types", ", "), F.lit(")"))
    return calls.filter("arg_types is not null").groupBy("func", shown.alias("signature")).agg(F.count(F.lit(1)).alias("n"))


def top_signatures(calls: DataFrame, k: int = 3) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("func").orderBy(F.desc("n"), "signature"))
    return signatures(calls).withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def call_totals(calls: DataFrame) -> DataFrame:
    """(func, n_calls, call_count): all calls, and those with a first argument."""
    return calls.groupBy("func").agg(F.count(F.lit(1)).alias("n_calls"), F.count_if(F.size("arg_types") > 0).alias("call_count"))


def type_prevalence(calls: DataFrame, k: int = 10) -> DataFrame:
    """(type, functions): the ``k`` types seen in the most functions."""
    pairs = calls.select("func", F.explode("arg_types").alias("type")).distinct()
    return pairs.groupBy("type").agg(F.count(F.lit(1)).alias("functions")).orderBy(F.desc("functions"), "type").limit(k)


def type_diversity(calls: DataFrame) -> DataFrame:
    """(types, functions): how many functions were seen with how many different types."""
    each = calls.select("func", F.explode("arg_types").alias("type")).groupBy("func").agg(F.countDistinct("type").alias("types"))
    return each.groupBy("types").agg(F.count(F.lit(1)).alias("functions"))


def polymorphic(calls: DataFrame) -> DataFrame:
    """(func, n_signatures, is_polymorphic) of every function: whether more than one signature was seen."""
    return signatures(calls).groupBy("func").agg(F.count(F.lit(1)).alias("n_signatures")).withColumn("is_polymorphic", F.col("n_signatures") > 1)


def top_polymorphic(calls: DataFrame, k: int = 10) -> DataFrame:
    return polymorphic(calls).filter("is_polymorphic").orderBy(F.desc("n_signatures"), "func").limit(k)


def enrich_functions(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """``functions(name)`` with observed_types, n_calls and is_polymorphic; null and false where nothing was seen."""
    types = calls.select("func", F.explode("arg_types").alias("type")).groupBy("func").agg(F.sort_array(F.collect_set("type")).alias("observed_types"))
    seen = polymorphic(calls).join(call_totals(calls), "func").join(types, "func", "left").withColumnRenamed("func", "name")
    return functions.join(seen.select("name", "observed_types", "n_calls", "is_polymorphic"), "name", "left").withColumn("is_polymorphic", F.coalesce("is_polymorphic", F.lit(False)))


def enriched_overview(enriched: DataFrame) -> DataFrame:
    """(functions, polymorphic, types): enriched functions, the polymorphic of them, all types seen."""
    seen = enriched.filter("observed_types is not null")
    return seen.agg(F.count(F.lit(1)).alias("functions"), F.count_if("is_polymorphic").alias("polymorphic"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("observed_types")))).alias("types"))


def dynamic_edges(pairs: DataFrame, functions: DataFrame) -> DataFrame:
    """(src, dst, type, n): DYNAMICALLY_CALLS counts between the nodes ``functions(id, name)`` of each pair's names."""
    named = functions.select("id", "name")
    found = pairs.join(named.select(F.col("id").alias("src"), F.col("name").alias("caller")), "caller").join(named.select(F.col("id").alias("dst"), F.col("name").alias("callee")), "callee")
    return found.select("src", "dst", F.lit("DYNAMICALLY_CALLS").alias("type"), "n")
