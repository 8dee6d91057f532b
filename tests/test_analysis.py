"""Traces, coverage, commits, patterns, validation, text, reports: goldens derived by hand."""

import json

from pyspark.sql import functions as F

from brindle.functions import paths, text
from brindle.functions.structure import extract
from brindle.operators import commit, coverage, graph, patterns, search, trace, validation
from brindle.plans import dynamic
from brindle.sources import changes, hunks, reports


def test_call_trace(spark, rows):
    events = [("call", "main", 0), ("call", "a", 1), ("call", "b", 2), ("return", "b", 2), ("return", "a", 1), ("call", "a", 1), ("return", "a", 1), ("return", "main", 0), ("return", "x", -1)]
    df = spark.createDataFrame([(1, i, *e) for i, e in enumerate(events)], "run int, seq long, event string, func string, depth int")
    pairs = trace.call_pairs(df)
    assert rows(pairs) == [("a", "b", 1), ("main", "a", 2)]
    assert tuple(trace.pair_totals(pairs).first()) == (2, 3, 3) and trace.degree_averages(pairs).first().avg_callees == 0.67
    assert trace.summary(df).first().max_depth == 2
    known = spark.createDataFrame([("a",), ("b",)], "name string")
    assert rows(trace.existing_pairs(pairs, known), "caller", "callee") == [("a", "b")] and rows(trace.missing_functions(pairs, known)) == [("main",)]
    assert rows(trace.callers_known(known, pairs)) == [("a",)]
    empty = trace.summary(df.limit(0)).first()
    assert empty.total_events == 0 and empty.max_depth == 0 and trace.degree_averages(pairs.limit(0)).first().avg_callees == 0.0


def test_runtime_types(spark, rows):
    calls = spark.createDataFrame([("f", ["int", "int"]), ("f", ["int", "int"]), ("f", ["str", "int"]), ("g", [])], "func string, arg_types array<string>")
    got = {(r.func, r.arg): ([(t.type, t.n) for t in r.types], r.observations) for r in trace.argument_types(calls).collect()}
    assert got[("f", 0)] == ([("int", 2), ("str", 1)], 3)
    assert rows(trace.top_signatures(calls), "func", "signature", "n") == [("f", "(int, int)", 2), ("f", "(str, int)", 1), ("g", "()", 1)]
    assert {r.func: r.is_polymorphic for r in trace.polymorphic(calls).collect()} == {"f": True, "g": False}
    assert {r.func: r.call_count for r in trace.call_totals(calls).collect()} == {"f": 3, "g": 0}
    assert rows(trace.type_prevalence(calls)) == [("int", 1), ("str", 1)] and rows(trace.type_diversity(calls)) == [(2, 1)]
    enriched = trace.enrich_functions(spark.createDataFrame([("f",), ("h",)], "name string"), calls)
    assert tuple(trace.enriched_overview(enriched).first()) == (1, 1, ["int", "str"])


def test_coverage(spark, rows):
    cov = spark.createDataFrame([("/w/pkg/a.py", [1, 2, 3, 5], [4, 6]), ("b.py", [], [])], "path string, executed_lines array<int>, missing_lines array<int>")
    assert rows(coverage.by_file(cov), "path", "percent") == [("/w/pkg/a.py", 66.67), ("b.py", 0.0)]
    functions = spark.createDataFrame([("pkg/a.py", "f", 4, 4), ("pkg/a.py", "g", 5, 7), ("pkg/ya.py", "h", 1, 9)], "path string, name string, start_line int, end_line int")
    assert rows(coverage.covered_functions(functions, cov), "name") == [("g",)] and coverage.covered_functions(functions, cov, "path").count() == 0
    ids = functions.select(F.col("name").alias("id"))
    suite = coverage.coverage_edges(ids, spark.createDataFrame([("t1",), ("t2",)], "id string"))
    assert suite.count() == 5 and coverage.expanded_coverage(suite, ids.filter("id <> 'h'")).count() == 4
    named = coverage.coverage_edges_by_name(spark.createDataFrame([("f", "t1"), ("f", "gone")], "function string, test string"), ids.withColumn("name", F.col("id")), spark.createDataFrame([("x", "t1")], "id string, name string"))
    assert rows(named) == [("f", "x", "COVERED_BY")]
    files = [("tests/test_a.py", "from pkg.a import x\nimport a, c.d\n"), ("pkg/a.py", ""), ("pkg/c.py", ""), ("pkg/__init__.py", ""), ("z.py", "")]
    ex = extract(spark.createDataFrame(files, "path string, content string"))
    mapping = coverage.tested_sources(ex, coverage.test_imports(ex))
    assert rows(mapping) == [("tests/test_a.py", "pkg/a.py"), ("tests/test_a.py", "pkg/c.py")] and rows(coverage.uncovered_sources(ex, mapping)) == [("z.py",)]
    assert rows(coverage.tested_sources(ex, coverage.test_imports(ex, "full_module"), "full_module")) == [("tests/test_a.py", "pkg/a.py")]
    report = coverage.mapping_report(ex, mapping).first()
    assert (report.tests, report.sources, report.covered, report.percent) == (1, 3, 2, 66.67)
    assert rows(graph.test_nodes(ex), "name") == [("test_a",)]


def test_hybrid(spark, rows):
    hits = lambda d: spark.createDataFrame(list(d.items()), "name string, score double")
    got = search.hybrid_search(hits({"A": 0.9, "B": 0.5}), hits({"B": 2.0, "C": 1.0})).collect()
    assert [(r.name, round(r.score, 6)) for r in got] == [("B", 1.1), ("A", 0.54), ("C", 0.4)]
    assert search.hybrid_search(hits({"A": 0.9, "B": 0.5}), hits({"B": 2.0}), normalize="minmax").first().name == "A"


def test_bm25_and_nearest_edges(spark):
    docs = spark.createDataFrame([(1, "alpha beta alpha"), (2, None), (3, "gamma")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in search.bm25(docs, "Alpha the ALPHA zeta").collect()}
    assert got[1] > 0 and got[2] == got[3] == 0
    assert search.bm25(docs.limit(0), "alpha").count() == 0
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [2.0, 0.0])], "vec_id long, embedding array<float>")
    near = [(r.vec_id, r.score) for r in search.nearest(vectors.filter("vec_id = 0"), vectors, 2).orderBy("rank").collect()]
    assert near == [(4, 1.0), (2, 0.707107)]
    assert [r.vec_id for r in search.vector_search(vectors.filter("vec_id <> 3"), [1.0, 0.0], 2).collect()] == [0, 4]


def test_stored_index_answers_as_the_texts_do(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta alpha"), (2, None), (3, "gamma beta"), (4, "beta beta the beta"), (5, "delta"), (6, "delta alpha")], "doc_id long, text string")
    index = search.build_index(docs, str(tmp_path / "i"))
    for question in ("alpha", "beta gamma beta", "the", "", "nothing known", "Delta ALPHA"):
        plain = {r.doc_id: round(r.score, 6) for r in search.bm25(docs, question).collect()}
        assert {r.key: round(r.score, 6) for r in index.scores(question).collect()} == plain
        for k in (1, 2, 6):
            assert [(r.key, r.score) for r in index.top(question, k).collect()] == sorted(plain.items(), key=lambda x: (-x[1], x[0]))[:k]
    assert search.build_index(docs.limit(0), str(tmp_path / "e")).top("alpha", 3).count() == 0


def test_commit(spark, rows):
    schema = "path string, status string, language string, additions int, deletions int, newContent string, hunks array<string>, changedSymbols array<struct<name:string,type:string,startLine:int,content:string>>"
    staged = lambda *r: spark.createDataFrame(list(r), schema)
    ok = ("a.py", "M", "python", 3, None, "x = 1", ["h"], [("f", "function", 1, ""), ("f", "function", 1, "again")])

    def verdict(df, diagnostics=None):
        found = commit.syntax_findings(df).unionByName(commit.scope_findings(df))
        return commit.recommend(commit.summarize(df), found, diagnostics).first().recommendation

    assert verdict(staged(ok).limit(0)) == "ready" and verdict(staged(ok)) == "ready"
    assert verdict(staged(("a.py", "M", "python", 1, 1, "def (", [], []))) == "blocked"
    six = ("b.py", "M", "python", 1, 1, "", ["h"], [(f"s{i}", "function", i, "") for i in range(6)])
    assert verdict(staged(six)) == "review" and rows(commit.scope_findings(staged(six)), "matched_pattern") == [("large-symbol-scope",)]
    assert rows(commit.scope_findings(staged(("c.py", "M", "python", 1, 1, "", ["h"] * 9, []))), "matched_pattern", "affected_file") == [("large-file-diff", "c.py")]
    assert verdict(staged(*[(f"f{i}.py", "M", "python", 1, 1, "", ["h"], []) for i in range(9)])) == "review"
    assert verdict(staged(ok), spark.createDataFrame([("failed",)], "d string")) == "review"
    total = commit.summarize(staged(ok)).first()
    assert (total.additions, total.deletions, total.symbols) == (3, 0, 2) and commit.changed_symbols(staged(ok)).count() == 1


def test_ignore_decisions(spark, rows):
    found = spark.createDataFrame([("a", "f", "p1", "r"), ("b", None, "p2", "r"), ("c", "g", "p2", "r")], "affected_file string, affected_symbol string, matched_pattern string, reason string").withColumn("severity", F.lit("warning"))
    decisions = spark.createDataFrame([("once", "a|f|p1|r"), ("once", "b||p2|r"), ("pattern", "p3")], "type string, key string")
    active, ignored = commit.split_ignored(found, decisions)
    assert rows(active, "affected_file") == [("c",)] and rows(ignored, "affected_file") == [("a",), ("b",)]
    assert commit.by_file(found).count() == 3


def test_patterns(spark, rows):
    like = "def {}(a, b):\n    try:\n        return {{}}\n    except E:\n        log(a)\n        check(b)\n        raise\n"
    symbols = spark.createDataFrame([("m.py", n, like.format(n)) for n in ("one", "two", "three")] + [("m.py", "validate_x", "def validate_x():\n    return 1\n"), ("m.py", "new", "def new(a, b, c, d):\n    return 1\n")], "path string, name string, content string")
    found = patterns.detect(symbols.filter("name = 'new'"), symbols)
    assert {r.matched_pattern for r in found.collect()} == {"return-style-drift", "exception-flow-drift", "helper-call-drift", "signature-shape-drift"}
    assert {r.matched_pattern: r.severity for r in found.collect()}["return-style-drift"] == "error"
    assert patterns.detect(symbols.filter("name = 'one'"), symbols).count() == 0
    low = spark.createDataFrame([("m.py", "new", "z", "", 0.3)], "path string, symbol string, name string, content string, score double")
    assert patterns.candidates(low).count() == 0


def test_validation(spark, rows):
    patches = spark.createDataFrame([(1,), (2,)], "patch int")
    issues = spark.createDataFrame([(1, "lint", "error"), (1, "type", "warning")], "patch int, stage string, severity string")
    stages = validation.stage_rows(patches, issues)
    assert rows(validation.roll_up(stages), "patch", "stages_run", "stages_failed", "passed") == [(1, 3, 1, False), (2, 3, 0, True)]
    assert rows(validation.roll_up(stages, continue_on_errors=False), "patch", "stages_run") == [(1, 2), (2, 3)]
    tests = spark.createDataFrame([(1, True)], "patch int, all_passed boolean")
    assert rows(validation.verdict(validation.roll_up(stages), tests), "patch", "valid") == [(1, False), (2, False)]
    metrics = validation.pipeline_metrics(spark.createDataFrame([(0, "a", True, 1.0), (1, "b", False, 2.0)], "position int, stage string, ok boolean, seconds double")).first()
    assert (metrics.successful, metrics.failed, metrics.first_failed) == (1, 1, "b")


def test_line_rules_and_indent_symbols(spark, rows):
    code = "def f(:\nx = 1\nif x:\n# note\ny = 2\n \tz = 3\nfoo::bar\nprint(1) if a = 2 else 3\nclass C:\n    def m(self):\n        pass\n\nasync def g():\n    pass"
    df = spark.createDataFrame([("a.py", code), ("b.py", None)], "path string, content string")
    assert rows(text.line_rules(df), "line", "issue_type", "severity") == [(1, "incomplete_block", "warning"), (3, "incomplete_block", "warning"), (6, "indentation", "warning"), (7, "common_issue", "warning"), (8, "common_issue", "warning")]
    got = rows(text.indent_symbols(df), "name", "type", "start_line", "end_line")
    assert got == [("C", "class", 9, 12), ("f", "function", 1, 1), ("g", "function", 13, 14), ("m", "function", 10, 12)]


def test_diffs(spark, rows):
    df = spark.createDataFrame([("a.py", "a\nb\nc", "a\nx\ny\nc"), ("b.py", None, ""), ("c.py", "s", "s")], "path string, old string, new string")
    s = {r.path: r.s for r in df.select("path", text.diff_stats(F.col("old"), F.col("new")).alias("s")).collect()}
    assert (s["a.py"].lines_modified, s["a.py"].total_changes, s["a.py"].similarity_ratio) == (2, 2, 0.5714) and s["b.py"].is_identical and s["c.py"].similarity_ratio == 1.0
    patch = df.filter("path = 'a.py'").select("path", text.diff(F.col("old"), F.col("new"), F.col("path")).alias("patch"))
    h = hunks.parse_hunks(patch).first()
    assert (h.oldStart, h.oldLines, h.newStart, h.newLines, h.changedOldLines, h.changedNewLines) == (1, 3, 1, 4, [2], [2, 3])
    symbols = spark.createDataFrame([("a.py", "f", "function", 1, 2), ("a.py", "g", "function", 4, 9)], "path string, name string, type string, start_line int, end_line int")
    assert rows(hunks.changed_symbols(hunks.parse_hunks(patch), symbols), "name", "changedLines") == [("f", [2])]
    assert "*** " in df.select(text.diff(F.col("old"), F.col("new"), F.col("path"), "context").alias("d")).first().d
    assert "! b | x" in df.select(text.diff(F.col("old"), F.col("new"), F.col("path"), "side_by_side").alias("d")).first().d


ANSWERS = (
    ("Sure:\n```python\ndef f():\n    pass\n```\nDone", "def f():\n    pass"),
    ("  x = 1  ", "x = 1"),
    ("Here it is\n\nimport os\nx = os\n", "import os\nx = os"),
    ("```\na = 1\n```\nand\n  ```py\nb = 2\n```", "a = 1\nb = 2"),
    ("```\nopen", "open"),
    ("```\na\n```\nprose\n    more", "a\n    more"),
    ("say\n@wraps\ndef g(): pass\n```\nleft out\n```\nend", "@wraps\ndef g(): pass\nend"),
    (None, None),
    ("", ""),
    ("```\n```", "```\n```"),
)


def test_code_of_response(spark):
    df = spark.createDataFrame(list(ANSWERS), "r string, code string")
    assert df.select(text.code_of_response(F.col("r")).eqNullSafe(F.col("code")).alias("same"), "r").filter("not same").collect() == []


def test_text_artefacts(spark):
    df = spark.createDataFrame([("x = 1\nreturn x", "try:\n    return validate_a (\n    return 2", "return-style-drift", None), ("a", "a", "", "")], "a string, b string, p string, c string")
    said = [r.said for r in df.select(text.explanation(F.col("a"), F.col("b"), F.col("p"), F.col("c")).alias("said")).collect()]
    assert said == ["answers the finding return-style-drift; returns in 2 places instead of 1; handles errors; calls validate_a", "has the shape of similar code"]
    given = spark.sql("SELECT array(struct('f' AS name, 0.8D AS score, 'doc' AS docstring)) r, array(struct('f' AS name, 'a.py' AS path, 'def f(): pass' AS code, array('g') AS neighbours)) c")
    assert "relevance: High" in given.select(text.prompt(F.lit("do"), F.col("r"), F.col("c")).alias("p")).first().p


def test_reports(spark, rows):
    out = lambda s: spark.createDataFrame([(1, s), (2, None)], "run int, stdout string")
    t = reports.trace(out('noise\n{"events": [{"event": "call", "func": "f", "depth": 0, "arg_types": ["int"]}], "call_counts": {"a->b": 2, "<module>->c": 1, "bad": 3}, "exit_code": 0}'))
    assert reports.trace_events(t).count() == 1 and rows(trace.counted_pairs(t)) == [("a", "b", 2)] and rows(t, "run", "exit_code") == [(1, 0), (2, -1)]
    cov = spark.createDataFrame([(1, json.dumps({"files": {"a.py": {"executed_lines": [1], "missing_lines": [2]}}}))], "run int, json string")
    assert rows(reports.coverage(cov), "path", "executed_lines", "excluded_lines") == [("a.py", [1], [])]
    lint = '[{"filename": "a.py", "location": {"row": 1, "column": 2}, "code": "E501", "message": "long"}]'
    assert rows(reports.lint(out(lint)), "line", "severity") == [(1, "error")] and rows(reports.lint(out("a.py:3:1: W291 blank\nnoise")), "line", "code") == [(3, "W291")]
    assert rows(reports.type_check(out("a.py:3:5: error: Bad thing [arg-type]\nb.py:1: note: See")), "column", "message", "code") == [(5, "Bad thing", "arg-type"), (None, "See", None)]
    assert rows(reports.test_summary(out("= 2 passed, 1 failed in 1.5s =")), "run", "passed", "failed", "all_passed", "duration") == [(1, 2, 1, False, 1.5), (2, 0, 0, False, 0.0)]
    assert rows(reports.test_results(out("t/test_a.py::test_x PASSED\n")), "test", "status") == [("test_x", "PASSED")]
    status = changes.name_status(spark.createDataFrame([("M\ta.py",), ("R90\told.py\tnew.py",), ("?? c.py",)], "value string"))
    assert rows(status, "change_type", "path", "old_path") == [("added", "c.py", None), ("modified", "a.py", None), ("renamed", "new.py", "old.py")]
    stat = changes.numstat(spark.createDataFrame([("1\t2\ta.py",), ("-\t-\tx/{b => c}/d.bin",)], "value string"))
    assert rows(stat) == [("a.py", 1, 2), ("x/c/d.bin", None, None)]
    assert changes.staged_files(status, stat).filter("additions = 1").first().language == "python"


def test_paths(spark):
    got = {p: spark.range(1).select(paths.is_test(F.lit(p)), paths.is_source(F.lit(p)), paths.watched(F.lit(p))).first() for p in ("tests/x.py", "a/test_b.py", "a/b.py", "a/__init__.py", "venv/a.py")}
    assert [tuple(r) for r in got.values()] == [(True, False, True), (True, False, True), (False, True, True), (False, False, True), (False, True, False)]
    assert paths.glob_regex("src/**/*.{py,pyi}") == "^src/(?:.*/)?[^/]*\\.(?:py|pyi)$"


def test_dynamic_plan(spark):
    ex = extract(spark.createDataFrame([("m.py", "def main():\n    a()\n\ndef a():\n    pass\n")], "path string, content string"))
    g = graph.build(ex)
    events = spark.createDataFrame([(1, 0, "call", "main", 0, []), (1, 1, "call", "a", 1, ["int"]), (1, 2, "return", "a", 1, None)], "run int, seq long, event string, func string, depth int, arg_types array<string>")
    done = dynamic.analyze(g, events)
    assert done.error is None and len(done.stages) == 5
    more = dynamic.enriched_graph(g, done)
    assert graph.edge_totals(more.edges).first().total == 1
    bad = dynamic.analyze(g, events.drop("depth"))
    assert bad.error and not bad.stages[-1][2]


def test_words_of_any_script(spark):
    from brindle.functions.text import tokens

    said = {"Größe der Straße für naïve": ["größe", "der", "straße", "für", "naïve"], "stra e": ["stra", "e"], "数据 处理_1, и слово!": ["数据", "处理_1", "и", "слово"], "été x2": ["été", "x2"], "the — and…": []}
    df = spark.createDataFrame([(t,) for t in said], "t string")
    assert {r.t: r.w for r in df.select("t", tokens(F.col("t")).alias("w")).collect()} == said


def test_search_tells_letters_apart(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Die Straße ist lang"), (2, "stra e und anderes"), (3, "nichts")], "doc_id long, text string")
    index = search.build_index(docs, str(tmp_path / "i"))
    assert [r.key for r in index.top("Straße", 1).collect()] == [1] and [r.key for r in index.top("stra", 1).collect()] == [2]


def test_answers_follow_a_folder_that_is_written_again(spark, tmp_path):
    from brindle.queries import base

    made, d = [], str(tmp_path / "in")
    make = lambda: made.append(1) or len(made)
    spark.range(3).write.parquet(f"{d}/t.parquet")
    assert [base.once(spark, "x", d, make) for _ in range(2)] == [1, 1]
    spark.range(4).write.mode("overwrite").parquet(f"{d}/t.parquet")
    assert [base.once(spark, "x", d, make) for _ in range(2)] == [2, 2] and base.once(spark, "y", d, make) == 3
