"""Extraction, graph building and the goldens of the design."""

import pytest
from pyspark.sql import functions as F

from brindle.functions.structure import complexity, extract, extracted, features
from brindle.operators import graph as G
from brindle.operators import symbols as S
from brindle.plans import retrieval
from brindle.sources import files
from brindle.sources.sinks import Store

PAIR = "def add(a, b):\n    return a + b\n\ndef subtract(a, b):\n    return a - b\n"
CODE = '''import os
from ..pkg import thing as t


class Base(dict, mod.Mixin):
    """Doc."""

    x = make()

    def method(self, a, /, b: int = 1, *args, c=2, **kw) -> str:
        """Says."""
        return self.other(helper(b))


async def run(job):
    def inner():
        return job.start()
    return inner()
'''


def test_extraction():
    row = extracted("a.py", CODE)
    by_name = {f["name"]: f for f in row["functions"]}
    assert set(by_name) == {"method", "run", "inner"}
    method = by_name["method"]
    assert method["class_name"] == "Base" and by_name["run"]["is_async"] and by_name["run"]["class_name"] is None
    assert [(p["name"], p["kind"], p["default"]) for p in method["parameters"]] == [
        ("self", "positional_only", None), ("a", "positional_only", None), ("b", "positional_or_keyword", "1"), ("args", "var_positional", None), ("c", "keyword_only", "2"), ("kw", "var_keyword", None)
    ]
    assert method["signature"] == "def method(b, *args, c, **kw)" and method["return_annotation"] == "str"
    assert {c["name"] for c in method["calls"]} == {"self.other", "helper"}
    assert [c["name"] for c in by_name["inner"]["calls"]] == ["job.start"] and [c["name"] for c in by_name["run"]["calls"]] == ["inner"]
    assert row["classes"][0]["bases"] == ["dict", "mod.Mixin"] and row["classes"][0]["methods"] == ["method"]
    assert [(i["type"], i["module"], i["name"], i["level"]) for i in row["imports"]] == [("import", "os", None, 0), ("from_import", "pkg", "thing", 2)]
    assert {s["name"] for s in row["symbols"]} == {"Base", "run", "inner"}  # methods are no symbols of a snapshot
    assert extracted("b.py", "def (")["parse_error"] and extracted("c.py", None)["functions"] == []


def test_complexity():
    import ast

    code = "def f():\n    if a and b or c:\n        pass\n    for x in y:\n        pass\n    try:\n        pass\n    except E:\n        pass\n    return [x for x in y if z]\n"
    assert complexity(ast.parse(code).body[0]) == 6


def test_features():
    got = features("def f(a, b):\n    try:\n        return {}\n    except E:\n        raise\n")
    assert got["return_style"] == "dict" and got["has_try_except"] and got["raises"] and got["parameter_count"] == 2
    assert features("  def f(")["return_style"] == "unknown" and features(None)["return_style"] == "none"


@pytest.fixture(scope="module")
def repo(spark):
    many = PAIR.replace("subtract", "multiply").replace("-", "*")
    content = {
        "a/ops.py": PAIR, "b/ops.py": PAIR, "c/ops.py": PAIR, "d/calc.py": many + "\n\nclass Calc:\n    pass\n", "e/calc.py": many,
        "main.py": "import os\nfrom a import ops\n\ndef total(x):\n    return add(x, multiply(x, 2))\n\nclass Sub(Calc):\n    pass\n",
    }
    return extract(files.from_records(spark, [{"path": p, "content": c} for p, c in content.items()])).cache()


def counts(df, key):
    return {r[0]: r[1] for r in df.groupBy(key).count().collect()}


def test_graph_by_path_and_content(repo):
    g = G.build(repo)
    assert counts(g.nodes, "label") == {"Repository": 1, "File": 6, "Function": 11, "Class": 2, "Module": 2}
    assert counts(g.edges, "type") == {"CONTAINS": 6, "DEFINES": 13, "IMPORTS": 2, "INHERITS": 1, "CALLS": 5 + 2}
    c = G.build(repo, identity="content")
    assert counts(c.nodes, "label")["Function"] == 4  # add, subtract, multiply and total: equal definitions at equal lines are one
    assert counts(c.edges, "type")["DEFINES"] == 13
    near = G.build(repo, resolve="same_file_first")
    assert counts(near.edges, "type")["CALLS"] == 7


def test_integrity_invalidation_and_update(spark, repo):
    g = G.build(repo)
    assert G.integrity(g).first().dangling == 0
    gone = G.invalidate(g, spark.createDataFrame([("a/ops.py",)], "path string"))
    assert counts(gone.nodes, "label")["Function"] == 9 and counts(gone.nodes, "label")["File"] == 6
    assert G.dangling(gone).count() == 0
    ids = G.symbols_of(g, spark.createDataFrame([("a/ops.py", "add")], "path string, name string"))
    row = G.impact(g, ids).first()
    assert row.relationships == 2 and row.labels == ["File", "Function"]
    assert tuple(G.removal_counts(g, ids).first()) == (1, 2)
    changed = extract(files.from_records(spark, [{"path": "a/ops.py", "content": "def fresh():\n    return total(1)\n"}]))
    merged, new = G.update_files(changed, repo)
    whole = G.build(extract(repo.select("path").filter("path <> 'a/ops.py'").join(repo.select("path", F.lit("").alias("content")), "path").limit(0)).unionByName(merged))
    key = lambda graph: sorted(tuple(r) for r in graph.edges.select("src", "dst", "type").collect())
    assert key(new) == key(whole)  # the incremental result is that of a full rebuild
    assert counts(new.edges, "type")["CALLS"] == 4 + 2 + 1
    again, same = G.update_files(changed, merged)
    assert key(same) == key(new)
    touched = G.modify(g, spark.createDataFrame([("main.py", "total", "def total(x, y)")], "path string, name string, signature string"))
    assert touched.nodes.filter("name = 'total'").first().signature == "def total(x, y)"
    twice = [("main.py", "total", "def total(a)", None, "2024-01-01 00:00:01", None), ("main.py", "total", "def total(b)", "says", "2024-01-01 00:00:02", False), ("main.py", "total", None, "was", "2024-01-01 00:00:00", True)]
    touched = G.modify(g, spark.createDataFrame(twice, "path string, name string, signature string, docstring string, modified_at string, invalidated boolean"))
    row = touched.nodes.filter("name = 'total'").collect()
    assert len(row) == 1 and (row[0].signature, row[0].docstring, row[0].invalidated, str(row[0].modified_at)) == ("def total(b)", "says", False, "2024-01-01 00:00:02")
    assert touched.nodes.count() == g.nodes.count() and touched.nodes.filter("invalidated").count() == 0


def test_expand_and_retrieve(spark, repo, tmp_path):
    g = G.build(repo)
    row = G.expand(g, spark.createDataFrame([("total",), ("absent",)], "name string")).collect()
    assert len(row) == 1 and [(n.name, n.direction) for n in row[0].neighbours] == [("add", "callee"), ("multiply", "callee")]
    found = retrieval.retrieve_context(g, "multiply two numbers", 3).collect()
    assert found[0].name == "multiply" and found[0].neighbours[0].name == "total"
    index = retrieval.build_index(g, str(tmp_path / "index"))
    assert [(r.name, round(r.score, 6)) for r in retrieval.retrieve_context(g, "multiply two numbers", 3, index=index).collect()] == [(r.name, round(r.score, 6)) for r in found]


def test_symbol_diff(spark):
    snap = lambda rows: spark.createDataFrame([("m.py", *r) for r in rows], "path string, name string, symbol_type string, signature string, docstring string")
    old = snap([("add", "function", "def add(a, b)", None), ("multiply", "function", "def multiply(a, b)", None), ("Calculator", "class", "class Calculator", "x")])
    new = snap([("add", "function", "def add(a, b, c)", "d"), ("power", "function", "def power(a, b)", None), ("Calculator", "class", "class Calculator", "x")])
    row = S.impact(S.summary(S.diff(old, new))).first()
    assert (row.added, row.removed, row.modified, row.total, row.impact_level, row.has_removals) == (1, 1, 1, 3, "medium", True)
    assert S.diff(old, old).count() == 0 and S.impact(S.summary(S.diff(old, old))).first().impact_level == "none"


def test_sources_and_store(spark, tmp_path):
    (tmp_path / "src" / "pkg").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "pkg" / "b.py").write_text("é\n")
    (tmp_path / "src" / "c.txt").write_text("no")
    got = {r.path: r.content for r in files.load_directory(spark, str(tmp_path / "src")).collect()}
    assert got == {"a.py": "x = 1\n", "pkg/b.py": "é\n"}
    with pytest.raises(ValueError):
        files.load_directory(spark, str(tmp_path / "src"), "*.rs")
    all_files = spark.createDataFrame([(p, "") for p in ("a/b.py", "venv/c.py", "gen/x_pb2.py", "d.md")], "path string, content string")
    assert [r.path for r in files.select_workspace(all_files, exclude=("**/*_pb2.py",)).collect()] == ["a/b.py"]
    store = Store(spark, str(tmp_path / "store"))
    assert store.upsert("t", spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), ["id"]) == {"created": 2, "updated": 0}
    assert store.upsert("t", spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), ["id"]) == {"created": 1, "updated": 1}
    assert sorted(map(tuple, store.read("t").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    store.write("t", store.read("t").filter("id > 1"))
    assert store.read("t").count() == 2 and store.reset("t") == {"t": 2} and not store.exists("t")
    analysis = extract(all_files.limit(1).withColumn("content", F.lit(CODE)))
    files.write_analysis(analysis, str(tmp_path / "analysis"))
    assert files.read_analysis(spark, str(tmp_path / "analysis")).first().functions[0].name
