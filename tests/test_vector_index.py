"""The inverted file of vectors against exact answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import search, vector_index


def clustered(n, size, clusters, seed):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(clusters, size))
    return centres[draw.integers(0, clusters, n)] + 0.35 * draw.normal(size=(n, size))


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(3000, 24, 30, 1))]
    rows += [(5000 + i, rows[7][1]) for i in range(40)]  # copies
    rows += [(6000, [0.0] * 24), (6001, None), (None, [1.0] * 24)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit("clash")).repartition(4).cache()


@pytest.fixture(scope="module")
def index(vectors, tmp_path_factory):
    return vector_index.build(vectors, str(tmp_path_factory.mktemp("vectors") / "index"))


def test_certified_answers_are_exact(spark, vectors, index, rows):
    asked = vectors.filter("vec_id % 50 = 0")
    exact = rows(search.nearest(asked, vectors, 6), "query", "vec_id", "score", "rank")
    assert rows(index.nearest(asked, 6, exact=True), "query", "key", "score", "rank") == exact
    assert rows(vector_index.opened(spark, index.path).nearest(asked, 6, probes=1, exact=True), "query", "key", "score", "rank") == exact
    for i in (0, 5003):
        q = list(vectors.filter(f"vec_id = {i}").first().embedding)
        assert [tuple(r) for r in index.top(q, 9, probes=1, exact=True).collect()] == [tuple(r) for r in search.vector_search(vectors, q, 9).collect()]


def test_recall_of_probes(vectors, index, rows):
    asked = vectors.filter("vec_id % 50 = 0")
    exact = {(q, k) for q, k in rows(search.nearest(asked, vectors, 5), "query", "vec_id")}
    found = {(q, k) for q, k in rows(index.nearest(asked, 5), "query", "key")}
    assert len(exact & found) >= 0.9 * len(exact)


def test_a_question_reads_its_lists_alone(index):
    stats = index.stats()
    assert stats["n"].sum() == 3041 and len(stats) == round(3041**0.5)
    few = index.top([1.0] * 24, 5, probes=2)
    assert "list IN" in few._jdf.queryExecution().toString() or "In(list" in few._jdf.queryExecution().toString()


def test_vectors_that_come_later(spark, vectors, tmp_path, rows):
    old, new = vectors.filter("vec_id < 2000"), vectors.filter("vec_id >= 2000")
    grown = vector_index.build(old, str(tmp_path / "i"), lists=20)
    grown.add(new)
    asked = vectors.filter("vec_id % 100 = 0")
    assert rows(grown.nearest(asked, 4, exact=True), "query", "key", "score", "rank") == rows(search.nearest(asked, vectors, 4), "query", "vec_id", "score", "rank")
    assert grown.stats()["n"].sum() == 3041


def test_few_and_no_vectors(spark, tmp_path):
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    index = vector_index.build(some, str(tmp_path / "two"))
    assert [(r.query, r.key) for r in index.nearest(some, 5, exact=True).orderBy("query").collect()] == [(1, 2), (2, 1)]
    empty = vector_index.build(some.limit(0), str(tmp_path / "none"))
    assert empty.nearest(some.limit(0), 5).count() == 0
