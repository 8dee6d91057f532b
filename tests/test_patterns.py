"""Ten labelled cases of drift, with bodies of our own: what is expected of each is its label."""

import pytest
from pyspark.sql import functions as F

from brindle.operators import commit, patterns

SERVICE = "def {}(request):\n    data = validate_input(request)\n    return service.save(data)\n"
REPLY = "def {}(item):\n    return {{'item': item}}\n"
GUARDED = "def {}(path):\n    try:\n        return read(path)\n    except OSError:\n        return read(DEFAULT)\n"
RAISING = "def {}(path):\n    return parse(read(path))\n"
COMPACT = "def {}(request):\n    return apply(request)\n"
CLASS = "class {}:\n    def __init__(self, store, clock):\n        self.store = store\n        self.clock = clock\n"

#: (label, the changed symbol, its body, the shape of its siblings, the finding that is expected or none)
CASES = {
    "aligned helper call": ("aligned", "create_user", SERVICE.format("create_user"), SERVICE, None),
    "missing validation": ("deviating", "create_user", "def create_user(request):\n    return service.save(request)\n", SERVICE, "helper-call-drift"),
    "return style": ("deviating", "build_response", "def build_response(item):\n    return (item, 200)\n", REPLY, "return-style-drift"),
    "aligned exceptions": ("aligned", "load_config", GUARDED.format("load_config"), GUARDED, None),
    "swallowed exception": ("deviating", "load_config", "def load_config(path):\n    try:\n        return parse(read(path))\n    except ValueError:\n        pass\n", RAISING, "exception-flow-drift"),
    "signature": ("deviating", "update_project", "def update_project(request, name, owner, force):\n    return apply(request)\n", COMPACT, "signature-shape-drift"),
    "aligned constructor": ("aligned", "ProjectAnalyzer", CLASS.format("ProjectAnalyzer"), CLASS, None),
    "layer boundary": ("deviating", "delete_account", "def delete_account(request):\n    return database.execute(request)\n", SERVICE, "helper-call-drift"),
}


@pytest.fixture(scope="module")
def findings(spark):
    changed = [(case, symbol, body) for case, (_, symbol, body, _, _) in CASES.items()]
    others = [(case, name, shape.format(name)) for case, (_, _, _, shape, _) in CASES.items() for name in ("first", "second", "third")]
    schema = "path string, name string, content string"
    found = patterns.detect(spark.createDataFrame(changed, schema), spark.createDataFrame(others, schema)).collect()
    return {case: {r.matched_pattern for r in found if r.affected_file == case} for case in CASES}


@pytest.mark.parametrize("case", CASES)
def test_labelled_case(findings, case):
    label, *_, expected = CASES[case]
    assert (expected in findings[case]) if label == "deviating" else findings[case] == set()


def test_blocked_and_review(spark):
    schema = "path string, language string, additions int, deletions int, newContent string, hunks array<string>, changedSymbols array<string>"
    broken = spark.createDataFrame([("h.py", "python", 1, 0, "def broken_handler(:\n    pass\n", ["h"], ["broken_handler"])], schema)
    found = commit.syntax_findings(broken)
    assert [r.matched_pattern for r in found.collect()] == ["python-syntax-error"] and commit.recommend(commit.summarize(broken), found).first().recommendation == "blocked"
    wide = spark.createDataFrame([("w.py", "python", 9, 9, "x = 1", ["h"], [f"s{i}" for i in range(9)])], schema)
    found = commit.scope_findings(wide)
    assert [r.matched_pattern for r in found.collect()] == ["large-symbol-scope"] and commit.recommend(commit.summarize(wide), found).first().recommendation == "review"


def test_siblings_are_bounded_before_they_meet(spark):
    rows = spark.createDataFrame([("m.py", f"f{i:03d}", f"{i % 3}") for i in range(300)] + [("m.py", "f001", "again")], "path string, name string, content string")
    got = patterns.siblings(rows.filter("name in ('f001', 'f200')"), rows)
    names = {r.symbol: sorted(x.name for x in got.collect() if x.symbol == r.symbol) for r in got.select("symbol").distinct().collect()}
    assert names["f200"] == ["f000", "f001", "f001", "f002", "f003", "f004", "f005", "f006"]
    assert sorted(set(names["f001"])) == ["f000", "f002", "f003", "f004", "f005", "f006", "f007", "f008"]
    assert got.filter(F.col("symbol") == F.col("name")).count() == 0
