"""Replay in chunks against a stack kept by hand."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brindle.operators import replay, trace

SCHEMA = "run int, seq long, event string, func string"


def by_hand(events):
    pairs, depths, stacks = Counter(), {}, {}
    for run, seq, event, func in sorted(events, key=lambda e: (e[0] is not None, e[0] or 0, e[1])):
        stack = stacks.setdefault(run, [])
        if event == "call":
            depths[run, seq] = len(stack)
            stack.append(func)
        elif event == "return":
            depths[run, seq] = len(stack) - 1
            if stack:
                stack.pop()
                if stack and stack[-1] is not None and func is not None:
                    pairs[stack[-1], func] += 1
    return pairs, depths


def traces(seed, runs, length, calls):
    rng = random.Random(seed)
    names = ["a", "b", "c", "d", None]
    return [(run, 3 * i, "line" if rng.random() < 0.05 else "call" if rng.random() < calls else "return", rng.choice(names)) for run in runs for i in range(length)]


@pytest.mark.parametrize("seed, runs, length, calls, chunks", [(1, [1], 900, 0.5, 16), (2, [1], 600, 0.6, 7), (3, [1], 600, 0.4, 7), (4, [1, 2, 3, None], 150, 0.5, 5)])
def test_same_as_a_stack(spark, seed, runs, length, calls, chunks):
    events = traces(seed, runs, length, calls)
    random.Random(seed).shuffle(events)
    df = spark.createDataFrame(events, SCHEMA)
    pairs, depths = by_hand(events)
    placed = replay.with_depth(df, chunks=chunks)
    assert {(r.run, r.seq): r.depth for r in placed.collect()} == depths
    assert placed.select("chunk").distinct().count() > 4  # one run is many tasks
    assert {(r.caller, r.callee): r.n for r in replay.call_pairs(df, chunks=chunks).collect()} == pairs


def test_same_as_the_window_over_depths(spark, rows):
    df = spark.createDataFrame([e for e in traces(5, [1, 2], 300, 0.55) if e[3]], SCHEMA)
    placed = replay.with_depth(df, chunks=6)
    assert rows(trace.call_pairs(placed), "caller", "callee", "n") == rows(replay.call_pairs(df, chunks=6), "caller", "callee", "n")


def test_open_calls_cross_many_chunks(spark, rows):
    """A root that stays open for the whole run is the caller in every chunk."""
    events = [(1, 0, "call", "root")] + [(1, i, *("call" if i % 2 else "return", "leaf")) for i in range(1, 401)] + [(1, 401, "return", "root"), (1, 402, "return", "gone")]
    df = spark.createDataFrame(events, SCHEMA)
    assert rows(replay.call_pairs(df, chunks=20), "caller", "callee", "n") == [("root", "leaf", 200)]
    assert replay.with_depth(df, chunks=20).filter("seq = 402").first().depth == -1


def test_empty_and_other_columns(spark):
    none = spark.createDataFrame([], SCHEMA).withColumn("chunk", F.lit("theirs")).withColumn("height", F.lit(1))
    assert replay.call_pairs(none).count() == 0 and replay.with_depth(none).count() == 0
