"""Stored neighbourhoods against the joins of the graph."""

import random

import pytest

from brindle.operators import context, graph
from brindle.plans import retrieval
from brindle.session import shared_path


def made(spark, seed, n):
    rng = random.Random(seed)
    nodes = [(f"n{i}", rng.choice(["Function", "Function", "Class", "File"]), f"f{rng.randrange(n // 2)}", f"p{rng.randrange(5)}.py", rng.randrange(90), f"code {i}") for i in range(n)]
    edges = [(f"n{rng.randrange(n + 2)}", f"n{rng.randrange(n)}", rng.choice(["CALLS", "CALLS", "DEFINES"])) for _ in range(4 * n)]
    return graph.Graph(spark.createDataFrame(nodes, "id string, label string, name string, path string, start_line int, content string"), spark.createDataFrame(edges, "src string, dst string, type string"))


def shown(df):
    return sorted((r.name, r.code, r.path, tuple(map(tuple, r.neighbours))) for r in df.collect())


@pytest.mark.parametrize("most", [1000, 3])
def test_same_as_joins(spark, monkeypatch, most):
    """Both ways: names read by value, and joined beyond ``MAX_NAMES``."""
    monkeypatch.setattr(context, "MAX_NAMES", most)
    g = made(spark, 4, 40)
    stored = context.build(g, shared_path(spark, "context"))
    names = spark.createDataFrame([(f"f{i}",) for i in (0, 1, 1, 5, 7, 9, 12)] + [("gone",), (None,)], "name string")
    expected = shown(graph.expand(g, names))
    assert shown(stored.expand(names)) == expected and any(r[3] for r in expected)
    hits = names.filter("name is not null").distinct().selectExpr("name", "cast(hash(name) as double) as score")
    assert retrieval.with_context(stored, hits).collect() == retrieval.with_context(g, hits).collect()


def test_a_question_reads_the_names_alone(spark):
    stored = context.build(made(spark, 5, 40), shared_path(spark, "context"))
    plan = stored.expand(spark.createDataFrame([("f1",)], "name string"))._jdf.queryExecution().toString()
    assert plan.count("PushedFilters: [In(name, [f1])]") + plan.count("EqualTo(name,f1)") >= 2, plan


def test_empty(spark):
    g = made(spark, 6, 10)
    stored = context.build(graph.Graph(g.nodes.limit(0), g.edges), shared_path(spark, "context"))
    assert stored.expand(spark.createDataFrame([("f1",)], "name string")).count() == 0
    assert stored.expand(spark.createDataFrame([], "name string")).count() == 0
