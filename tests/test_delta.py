"""The graph kept by deltas against one that is built anew."""

import random

from pyspark.sql import functions as F

from brindle.functions.structure import extract
from brindle.operators import delta
from brindle.operators import graph as G
from brindle.sources.sinks import Store
from brindle.streaming import loop

NAMES = "abcdef"


def code(draw):
    parts = [f"import {draw.choice(['os', 're', 'json'])}\n"] * draw.randint(0, 1)
    parts += [f"def {draw.choice(NAMES)}():\n    {draw.choice(NAMES)}()\n    {draw.choice(NAMES)}()\n" for _ in range(draw.randint(0, 3))]
    parts += [f"class {draw.choice('XYZ')}({draw.choice('XYZ')}):\n    pass\n" for _ in range(draw.randint(0, 2))]
    return "\n".join(parts)


def step(spark, number, files, changed):
    rows = [(p, "deleted" if files.get(p) is None else "modified", number, None, files.get(p)) for p in changed]
    return spark.createDataFrame(rows, "file_path string, change_type string, ts long, old_path string, content string").withColumn("ts", F.timestamp_seconds("ts"))


def test_random_batches_equal_a_build(spark, tmp_path, rows):
    draw, files, store, config = random.Random(11), {}, Store(spark, str(tmp_path / "s")), loop.Config(maintain=True)
    for number in range(3):
        changed = [f"p{i}.py" for i in draw.sample(range(8), 8 if not number else 3)]
        for p in changed:
            files[p] = None if draw.random() < 0.25 else code(draw)
        loop.apply_changes(store, step(spark, number, files, changed), config, batch=number)
        whole = G.build(extract(spark.createDataFrame([(p, c) for p, c in files.items() if c is not None], "path string, content string")))
        kept = loop.graph(store, config)
        assert rows(kept.edges, *delta.EDGE) == rows(whole.edges, *delta.EDGE)
        assert rows(kept.nodes.drop("updated_at")) == rows(whole.nodes.drop("updated_at"))
        assert kept.edges.count() == kept.edges.distinct().count()


def test_other_names_are_neither_read_nor_written(spark, tmp_path, monkeypatch):
    store, config = Store(spark, str(tmp_path / "s")), loop.Config(maintain=True)
    files = {f"p{i}.py": f"def f{i}():\n    f{i + 1}()\n" for i in range(150)}
    loop.apply_changes(store, step(spark, 0, files, files), config, batch=0)
    parts = lambda t: dict(store._manifest()["tables"][t]["parts"])
    before, read = {t: parts(t) for t in ("names_functions", "names_by_caller", "graph_edges")}, {}
    plain = Store.read
    monkeypatch.setattr(Store, "read", lambda self, name, parts=None: (read.setdefault(name, set()).update(["all"] if parts is None else parts), plain(self, name, parts))[1])
    files["p7.py"] = "def f7():\n    f9()\n"
    loop.apply_changes(store, step(spark, 1, files, ["p7.py"]), config, batch=1)
    assert all("all" not in read[t] and len(read[t]) <= 4 for t in ("names_functions", "names_by_caller", "names_by_callee"))
    for table, old in before.items():
        now = parts(table)
        assert sum(old[p] != now.get(p) for p in old) <= 2
