"""Steps whose work or memory once grew faster than their input."""

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from brindle import queries as library
from brindle.functions import text
from brindle.functions.structure import FILES, extract
from brindle.functions.vectors import hashed_embedding
from brindle.operators import context, graph, lines, live_index, patterns, search, vector_index
from brindle.sources import hunks
from brindle.sources.sinks import Store
from brindle.streaming import loop


def test_prose_that_begins_like_code(spark, tmp_path):
    rows = [(1, "for the and\nwith a::b\n\tif x = 1", "en"), (2, None, "de"), (3, "while\r\n \tdef", "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert [tuple(r) for r in library.QUERIES["line_rules_prose"](spark, str(tmp_path)).collect()] == con.execute(library.SQL["line_rules_prose"]).fetchall()


def test_words_are_hashed_once(spark):
    size = 64
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None), (4, [f"w{i}" for i in range(500)]), (5, ["a", None])], "id int, words array<string>").repartition(1)
    hashed = F.explode("words")
    said = rows.select("id", hashed.alias("w")).groupBy("id", F.pmod(F.xxhash64("w"), F.lit(size)).alias("b")).agg(F.sum(F.when(F.pmod(F.xxhash64("w", F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)).alias("s"))
    expected = {i: [0.0] * size for i in (1, 2, 4, 5)}
    for r in said.collect():
        expected[r.id][r.b] = r.s
    found = rows.select("id", hashed_embedding(F.col("words")).alias("v"))
    assert {r.id: r.v for r in found.collect()} == expected | {3: None}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") == 2  # the bucket and the sign, and not for each of the buckets


def test_structure_leaves_in_small_batches(spark):
    files = spark.range(0, 3 * FILES, 1, 1).select(F.concat(F.lit("p"), "id").alias("path"), F.concat(F.lit("def f"), "id", F.lit("(a: int = 1):\n    return g(a)\n")).alias("content"))
    sizes = extract(files).mapInPandas(lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches), "n long")
    assert sum(r.n for r in sizes.collect()) == 3 * FILES

    def run(f, batch):
        return [b.num_rows for b in f(iter([batch]))]

    # what a worker makes of one batch
    seen = {}

    class Files:
        select = lambda self, *_: self
        mapInArrow = lambda self, f, schema: seen.update(f=f)

    extract(Files())
    whole = pa.RecordBatch.from_pydict({"path": ["p"] * (2 * FILES + 1), "content": ["x = 1"] * (2 * FILES + 1)})
    assert run(seen["f"], whole) == [FILES, FILES, 1]


def test_candidates_are_parsed_once(spark):
    rows = [("p", "s", f"c{i}", f"def c{i}(a):\n    validate(a)\n    return {i}\n", 0.9 - i / 10, i + 1) for i in range(3)]
    found = patterns.conventions(spark.createDataFrame(rows, "path string, symbol string, name string, content string, score double, rank int"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    row = found.first()
    assert (row.return_style, row.parameter_count, row.common_calls, row.common_imports, row.examples, row.score) == ("int", 1, ["validate"], [], ["c0", "c1", "c2"], 0.9)


def test_a_part_of_the_extraction_is_few_files(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    changes = spark.range(0, 400, 1, 8).select(F.concat(F.lit("p"), "id").alias("file_path"), F.lit("added").alias("change_type"), F.timestamp_seconds("id").alias("ts"), F.lit(None).cast("string").alias("old_path"), F.lit("def f():\n    pass\n").alias("content"))
    loop.apply_changes(store, changes, batch=0)
    assert len(store.read("extracted").inputFiles()) == len(store.parts("extracted"))


def test_questions_of_wide_lists_leave_in_blocks(spark, tmp_path):
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=16).tolist()) for i in range(1500)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(1)
    index = vector_index.build(vectors, f"{tmp_path}/index", lists=40)
    found = index.nearest(vectors.filter("vec_id % 3 = 0"), 5, exact=True)
    assert "RepartitionByExpression" not in found._jdf.queryExecution().logical().toString()  # questions are not one row for each list
    same = lambda df: sorted((r.query, r[1], r.rank) for r in df.collect())
    assert same(found) == same(search.nearest(vectors.filter("vec_id % 3 = 0"), vectors, 5).select("query", "vec_id", "score", "rank"))


def test_orphans_tell_ends_apart_once(spark, sf_dir):
    plan = library.QUERIES["orphans"](spark, sf_dir)._jdf.queryExecution().analyzed().toString()
    assert plan.count("Deduplicate") == 1  # of ends, not of edges before


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_of_different_documents_are_not_shuffled(spark, tmp_path):
    docs = spark.createDataFrame([(1, "blue red blue"), (2, None), (3, "red " * 70 + "blue")], "doc_id long, text string")
    found = search.postings(docs)
    assert "Exchange" not in _plan(found)
    assert {tuple(r) for r in found.select("key", "dl", "term", "tf").collect()} == {(1, 3, "red", 1), (1, 3, "blue", 2), (2, 0, None, 1), (3, 71, "red", 70), (3, 71, "blue", 1)}
    again = search.postings(docs.union(docs))  # rows of one key and length are one document
    assert {tuple(r) for r in again.select("key", "term", "tf").collect()} == {(1, "red", 2), (1, "blue", 4), (2, None, 2), (3, "red", 140), (3, "blue", 2)}
    many = spark.range(0, 300, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("every w"), F.col("id") % 7).alias("text"))
    index = search.build_index(many, f"{tmp_path}/many")
    held = [tuple(r) for r in index.table("postings").select("term", "key", "dl", "tf").collect()]
    assert sorted(held) == sorted([("every", i, 2, 1) for i in range(300)] + [(f"w{i % 7}", i, 2, 1) for i in range(300)])


def test_postings_leave_a_task_by_term(spark, monkeypatch):
    monkeypatch.setattr(search, "CHUNK", 6)
    rows = pa.RecordBatch.from_pydict({"key": ["x", "y", "z"], "dl": pa.array([2, 3, 9], pa.int64()), "terms": ["a b", "b", "a b c d e f g"], "tfs": pa.array([[1, 1], [3], [1, 1, 1, 1, 1, 1, 3]], pa.list_(pa.int32()))})
    made = list(search._blocks(iter([rows.slice(0, 1), rows.slice(1)])))
    got = [(t, k, c >> 32, c & 0xFFFFFFFF) for b in made for t, keys, counts in zip(*(c.to_pylist() for c in b.columns)) for k, c in zip(keys, counts)]
    assert sorted(got) == sorted([("a", "x", 2, 1), ("b", "x", 2, 1), ("b", "y", 3, 3), ("g", "z", 9, 3)] + [(t, "z", 9, 1) for t in "abcdef"])
    assert [b.num_rows for b in made] == [2, 7]  # of one term one row


def test_words_of_a_batch_are_written_once(spark, tmp_path, monkeypatch):
    made = {}
    monkeypatch.setattr(live_index, "_stored", lambda df, name, stored=live_index._stored: made.update({name: stored(df, name)}) or made[name])
    store = Store(spark, f"{tmp_path}/store")
    docs = spark.createDataFrame([(1, "red blue red"), (2, None), (3, "blue")], "doc_id long, text string")
    live_index.apply(store, docs, batch=0)
    live_index.apply(store, docs.filter("doc_id = 1"), docs.filter("doc_id = 3").select("doc_id"), batch=1)
    assert "keyword-new" not in made and made["keyword-old"].columns == ["key", "dl", "segment"]  # which documents went, without their words
    assert {(r.key, r.terms, tuple(r.tfs)) for r in store.read(live_index.DOCS).filter("segment = 1").collect()} == {(1, "blue red", (1, 2))}
    assert {(r.term, r.df) for r in live_index.LiveIndex(spark, store.root).table("terms").collect()} == {("red", 1), ("blue", 1)}


def test_blocks_of_changed_lines_are_not_repeated(spark):
    ranges = spark.createDataFrame([("m", "f", 0, 130), ("m", "g", 63, 64), ("n", "h", 5, 5)], "path string, name string, start_line int, end_line int")
    points = spark.createDataFrame([("m", i) for i in (0, 63, 64, 127, 131)] + [("m", 0), ("n", 6)], "key string, line int")
    found = lines.inside(ranges, points, "path", "at")
    assert found.schema["at"].dataType.simpleString() == "int" and _plan(found).count("Generate") == 2  # blocks of ranges, and lines that are found
    assert sorted((r.name, r.at) for r in found.collect()) == [("f", 0), ("f", 63), ("f", 64), ("f", 127), ("g", 63), ("g", 64)]


def test_patches_are_parsed_within_rows(spark):
    patch = "diff --git a/m b/m\n--- a/m\n+++ b/m\n@@ -5,3 +5,4 @@ def f\n a\n-b\n+c\n+d\n\\ No newline at end of file\n+++ e\n-f\n@@ -20 +30,0 @@\n-g\n@@ -40,0 +50,0 @@\n@@ -60,1 +70,1 @@\n x"
    found = hunks.parse_hunks(spark.createDataFrame([("p", patch), ("q", None), (None, "@@ -1 +1 @@\n+z")], "path string, patch string"))
    assert "Window" not in _plan(found) and "Exchange" not in _plan(found)
    rows = {(r.path, r.hunk, r.oldStart, r.oldLines, r.newStart, r.newLines, tuple(r.changedOldLines), tuple(r.changedNewLines)) for r in found.collect()}
    assert rows == {("p", 1, 5, 3, 5, 4, (6, 7), (6, 7)), ("p", 2, 20, 1, 30, 0, (20,), ()), ("p", 4, 60, 1, 70, 1, (), ()), (None, 1, 1, 1, 1, 1, (), (1,))}


def test_edges_are_shuffled_before_they_are_counted(spark):
    edges = spark.createDataFrame([("a", "b", "CALLS"), ("a", "b", "CALLS"), ("b", "a", "CALLS"), ("a", "a", "CALLS"), ("a", "c", "DEFINES")], "src string, dst string, type string")
    found = graph.neighbours(edges, spark.createDataFrame([("a",), ("a",), (None,)], "id string"))
    assert sorted(tuple(r) for r in found.collect()) == [("a", "a", "caller"), ("a", "b", "caller")]
    plan = _plan(graph.neighbours(edges, edges.select(F.col("src").alias("id"))))
    assert "SortAggregate" not in plan and plan.index("partial_max") < plan.index("REPARTITION_BY_COL")  # plans are printed from their end


def test_neighbours_are_dealt_before_they_are_counted(spark):
    g = graph.Graph(spark.createDataFrame([("1", "Function", "f", "p"), ("2", "Function", "g", "q"), ("3", "Class", "g", "r")], "id string, label string, name string, path string"), spark.createDataFrame([("1", "2", "CALLS"), ("1", "2", "CALLS"), ("1", "3", "CALLS"), ("2", "1", "CALLS")], "src string, dst string, type string"))
    plan, found = _plan(context.neighbours_by_name(g)), context.neighbours_by_name(g)
    assert sorted(tuple(r) for r in found.collect()) == [("f", "g", "caller", "q"), ("g", "f", "caller", "p")]
    assert plan.index("partial_max") < plan.index("rangepartitioning") and plan.count("rangepartitioning") == 1  # plans are printed from their end


ODD = [(1, "Red, red—BLUE;\tthe x_1 _"), (2, None), (3, ""), (4, "end"), (5, "start END"), (6, "— “” …"), (7, "Straße İstanbul ΟΔΟΣ naïve áb z‍q 日本語、東京 ٣٤ Ⅷ ½ 😀ok a\x00b"), (None, "the and"), (8, "w" * 50 + " " + "é" * 50), (9, "x")]


def test_words_are_counted_by_batches(spark, monkeypatch):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").coalesce(1)
    found = search.counted(docs)
    plan = _plan(found)
    assert "MapInArrow" in plan and "array_distinct" not in plan and "lambda" not in plan and "Exchange" not in plan
    words = {r.doc_id: r.w for r in docs.select("doc_id", text.tokens(F.col("text")).alias("w")).collect()}
    expected = {k: (len(w), " ".join(sorted(set(w), key=str.encode)), [w.count(x) for x in sorted(set(w), key=str.encode)]) for k, w in words.items()}
    assert {r.key: (r.dl, r.terms, r.tfs) for r in found.collect()} == expected
    assert search.counted(docs.limit(0)).count() == 0
    # what a worker makes of pieces that hold one text, several, or less than one
    rows = pa.RecordBatch.from_pydict({"key": [1, 2, 3, 4, 5], "text": ["b q", "q", "", "the b.b", "c" * 30]}).slice(1)
    for size in (1, 3, 100):
        monkeypatch.setattr(search, "PIECE", size)
        made = [r for b in search._counts(iter([rows])) for r in b.to_pylist()]
        assert [(r["key"], r["dl"], r["terms"], r["tfs"]) for r in made] == [(2, 1, "q", [1]), (3, 0, "", []), (4, 2, "b", [2]), (5, 1, "c" * 30, [1])]


def test_postings_are_written_where_they_are_made(spark, monkeypatch):
    monkeypatch.setattr(search, "CHUNK", 6)
    docs = spark.createDataFrame([(i, f"every w{i % 3} again w{i % 2}") for i in range(9)] + [(9, None)], "doc_id long, text string").coalesce(1)
    counts = search.counted(docs)
    found = search.in_runs(counts)
    assert "Exchange" not in _plan(found) and "Sort" not in _plan(found)
    assert sorted(tuple(r) for r in found.collect()) == sorted((r.term, r.key, r.dl, r.tf) for r in search.postings(docs).filter("term is not null").collect())
    rows = pa.RecordBatch.from_pydict({"key": ["x", "y"], "dl": pa.array([2, 2], pa.int64()), "terms": ["b c", "a b"], "tfs": pa.array([[1, 1], [1, 1]], pa.list_(pa.int32()))})
    assert [b.column("term").to_pylist() for b in search._blocks(iter([rows]))] == [["a", "b", "c"]]  # a run lies by term
    said = {}
    for r in search.frequencies(counts).collect():
        said[r.term] = said.get(r.term, 0) + r.df
    assert said == {"every": 9, "w0": 6, "w1": 5, "w2": 3}


def test_merged_segments_are_listed_from_their_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live_index, "FANOUT", 2)
    store, read = Store(spark, f"{tmp_path}/store"), []
    monkeypatch.setattr(Store, "read", lambda self, name, parts=None, of=Store.read: read.append(name) or of(self, name, parts))
    live_index.apply(store, spark.createDataFrame([(1, "red blue red"), (2, "blue")], "doc_id long, text string"), batch=0)
    live_index.apply(store, spark.createDataFrame([(1, "green")], "doc_id long, text string"), batch=1)
    assert live_index.POSTINGS not in read and live_index.segments(store) == [(1, 1)]
    assert sorted((r.term, r.key, r.tf) for r in store.read(live_index.POSTINGS).collect()) == [("blue", 2, 1), ("green", 1, 1)]


def test_a_part_without_rows_is_none(spark, tmp_path):
    store, rows = Store(spark, f"{tmp_path}/store"), spark.range(3)
    assert store.stage("t", rows.limit(0), None, "p").parts == {} and store.stage("t", rows, None, "p").rows.count() == 3
    store.commit(parts={"t": (store.stage("t", rows, None, "p"), "part", [])})
    assert store.parts("t") == ["p"] and store.read("t").count() == 3 and store.read("t", ["q"]).count() == 0
    assert "Python" not in _plan(store.read("t", ["q"])) and "ExistingRDD" not in _plan(store.read("t", ["q"]))
