"""The maintenance loop: a stream gives what a batch gives."""

from pyspark.sql import functions as F

from brindle.functions.structure import extract
from brindle.operators import graph as G
from brindle.sources import changes
from brindle.sources.sinks import Store
from brindle.streaming import loop


def test_stream_is_batch(spark, tmp_path):
    landing, store = str(tmp_path / "landing"), Store(spark, str(tmp_path / "store"))
    loop.enqueue(spark, landing, [{"file_path": "a.py", "change_type": "added", "content": "def f():\n    g()\n"}, {"file_path": "notes.txt", "change_type": "added", "content": "x"}])
    runner = loop.MaintenanceLoop(lambda: changes.watch(spark, landing, 1), store, str(tmp_path / "checkpoint"))
    runner.start(available_now=True).awaitTermination()
    assert store.read("extracted").count() == 1
    loop.enqueue(spark, landing, [{"file_path": "b.py", "change_type": "added", "content": "def g():\n    pass\n\ndef old():\n    pass\n"}])
    loop.enqueue(spark, landing, [{"file_path": "b.py", "change_type": "modified", "content": "def g():\n    pass\n"}, {"file_path": "c.py", "change_type": "deleted"}])
    runner.resume(available_now=True).awaitTermination()
    whole = G.build(extract(spark.createDataFrame([("a.py", "def f():\n    g()\n"), ("b.py", "def g():\n    pass\n")], "path string, content string")))
    edges = lambda df: sorted(tuple(r) for r in df.select("src", "dst", "type").collect())
    assert edges(loop.graph(store).edges) == edges(whole.edges)
    loop.publish(store)
    assert edges(store.read("edges")) == edges(whole.edges) and store.read("nodes").count() == whole.nodes.count()
    assert loop.MaintenanceLoop(runner.source, store, runner.checkpoint).metrics.processed == 4  # a new loop goes on counting
    status = runner.status()
    assert not status["running"] and status["healthy"] and status["processed"] == 4 and status["failed"] == 0
    assert runner.events(5) and runner.configure(interval="1 second").interval == "1 second"
    assert [r.file_path for r in loop.peek(spark, landing, 2).collect()][0] == "a.py"
    other = str(tmp_path / "other")  # a new stream counts its batches from 0 and is not taken for one that was seen
    loop.enqueue(spark, other, [{"file_path": "d.py", "change_type": "added", "content": "def d():\n    pass\n"}])
    loop.MaintenanceLoop(lambda: changes.watch(spark, other, 1), store, str(tmp_path / "new")).start(available_now=True).awaitTermination()
    assert sorted(r.path for r in store.read("extracted").collect()) == ["a.py", "b.py", "d.py"]
    assert loop.queue_status(spark.read.json(landing)).count() == 3


def test_watermarked_activity(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("change_type"), F.col("ts").cast("timestamp").alias("ts"))
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = loop.activity(stream).writeStream.outputMode("complete").format("memory").queryName("activity").trigger(availableNow=True).start()
    q.awaitTermination()
    expected = events.groupBy(F.window("ts", "1 hour"), "change_type").count().agg(F.count(F.lit(1)), F.sum("count")).first()
    assert tuple(spark.table("activity").agg(F.count(F.lit(1)), F.sum("n")).first()) == tuple(expected)


def test_poll_sees_a_change_once(spark, rows):
    df = spark.createDataFrame([("a.py", "modified", "2024-01-01", "x"), ("a.py", "modified", "2024-01-02", "x"), ("a.py", "modified", "2024-01-03", "y"), (".git/b.py", "modified", "2024-01-01", "x")], "path string, change_type string, ts string, content string")
    assert rows(changes.poll(df), "ts") == [("2024-01-01",), ("2024-01-03",)]
    assert rows(changes.event_counts(df)) == [("modified", 4)]


CODE = "def {0}():\n    pass\n"


def change(path, kind, ts, content=None, old=None):
    return (path, kind, f"2024-01-01 00:00:{ts:02d}", old, content)


def batch_of(spark, *rows):
    return spark.createDataFrame(list(rows), "file_path string, change_type string, ts string, old_path string, content string").withColumn("ts", F.col("ts").cast("timestamp"))


def held(store):
    return {r.path: sorted(s.name for s in r.symbols) for r in store.read("extracted").collect()}


def test_order_within_a_batch(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    loop.apply_changes(store, batch_of(spark, change("a.py", "added", 1, CODE.format("a")), change("k.py", "added", 1, CODE.format("k"))), batch=0)
    got = loop.apply_changes(store, batch_of(spark, change("b.py", "renamed", 2, None, "a.py"), change("b.py", "modified", 3, CODE.format("b")), change("k.py", "modified", 3)), batch=1)
    assert held(store) == {"b.py": ["b"], "k.py": ["k"]}  # the old path is gone, a change without content waits for it
    assert sorted((r.path, r.name, r.change_type) for r in got.collect()) == [("a.py", "a", "removed"), ("b.py", "b", "added")]
    loop.apply_changes(store, batch_of(spark, change("c.py", "renamed", 4, None, "b.py"), change("b.py", "added", 5, CODE.format("again"))), batch=2)
    assert held(store) == {"c.py": ["b"], "b.py": ["again"], "k.py": ["k"]}  # a rename without content moves what there was
    assert store.read("symbol_changes").count() > 2


def test_retries_change_nothing_and_parts_stay(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    loop.apply_changes(store, batch_of(spark, *[change(f"f{i}.py", "added", 1, CODE.format(f"f{i}")) for i in range(30)]), batch=0)
    before = store._manifest()["tables"]["extracted"]["parts"]
    step = batch_of(spark, change("f1.py", "modified", 2, CODE.format("new")))
    point = Store._point
    monkeypatch.setattr(Store, "_point", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    try:
        loop.apply_changes(store, step, batch=1)
        raise AssertionError
    except OSError:
        monkeypatch.setattr(Store, "_point", point)
    assert held(store)["f1.py"] == ["f1"] and store.batch() == 0
    first = sorted(map(tuple, loop.apply_changes(store, step, batch=1).collect()))
    again = sorted(map(tuple, loop.apply_changes(store, step, batch=1).collect()))
    assert first == again and len(first) == 2 and held(store)["f1.py"] == ["new"]
    after = store._manifest()["tables"]["extracted"]["parts"]
    assert sum(before[p] != after[p] for p in before) == 1  # only the part of the path was written


def test_random_batches_with_retries_equal_a_rebuild(spark, tmp_path):
    import random

    draw, store, files, clock = random.Random(3), Store(spark, str(tmp_path / "s")), {}, 0
    for number in range(5):
        rows = []
        for _ in range(7):
            clock += 1
            kind, path = draw.choice(["added", "modified", "deleted", "renamed", "modified"]), f"p{draw.randrange(6)}.py"
            content = f"def g{draw.randrange(5)}():\n    g{draw.randrange(5)}()\n"
            if kind == "deleted":
                files.pop(path, None)
                rows.append(change(path, kind, clock))
            elif kind == "renamed":
                old = f"p{draw.randrange(6)}.py"
                if old == path:
                    continue
                given = draw.choice((content, None, None))
                held_then = files.pop(old, None)
                files[path] = given or held_then
                if files[path] is None:
                    files.pop(path)
                rows.append(change(path, kind, clock, given, old))
            else:
                files[path] = content
                rows.append(change(path, kind, clock, content))
        for _ in range(draw.choice((1, 2))):
            loop.apply_changes(store, batch_of(spark, *rows), batch=number)
        assert held(store) == {p: [c[4:6]] for p, c in files.items()}
    whole = G.build(extract(spark.createDataFrame(sorted(files.items()), "path string, content string")))
    edges = lambda df: sorted(tuple(r) for r in df.select("src", "dst", "type").collect())
    assert edges(loop.graph(store).edges) == edges(whole.edges)


def test_renames_without_content_take_what_was_there_just_then(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    loop.apply_changes(store, batch_of(spark, *[change(f"{n}.py", "added", 1, CODE.format(n)) for n in "adgx"]), batch=0)
    moves = [change("a.py", "modified", 2, CODE.format("new")), change("b.py", "renamed", 3, None, "a.py")]  # what the batch itself gave
    moves += [change("e.py", "renamed", 2, None, "d.py"), change("f.py", "renamed", 3, None, "e.py")]  # twice
    moves += [change("y.py", "added", 2, CODE.format("y")), change("z.py", "renamed", 3, None, "y.py")]  # new in the batch
    moves += [change(f"h{i}.py", "renamed", 3 + i, None, f"h{i - 1}.py" if i else "g.py") for i in range(20)]  # a long chain
    moves += [change("x.py", "deleted", 2), change("w.py", "renamed", 3, None, "x.py"), change("v.py", "renamed", 3, None, "nowhere.py")]  # nothing
    moves += [change("b.py", "modified", 4)]  # without content
    loop.apply_changes(store, batch_of(spark, *moves).repartition(3), batch=1)
    assert held(store) == {"b.py": ["new"], "f.py": ["d"], "z.py": ["y"], "h19.py": ["g"]}
    swap = [change("t.py", "renamed", 5, None, "b.py"), change("b.py", "renamed", 6, None, "f.py"), change("f.py", "renamed", 7, None, "t.py")]
    loop.apply_changes(store, batch_of(spark, *swap), batch=2)
    assert held(store) == {"b.py": ["d"], "f.py": ["new"], "z.py": ["y"], "h19.py": ["g"]}
    loop.apply_changes(store, batch_of(spark, change("q.py", "renamed", 8, None, "b.py"), change("r.py", "renamed", 8, None, "q.py")), batch=3)
    assert held(store) == {"q.py": ["d"], "f.py": ["new"], "z.py": ["y"], "h19.py": ["g"]}  # at one time, all take what was there before


def test_queue(spark, tmp_path):
    queue = loop.ChangeQueue(Store(spark, str(tmp_path / "q")))
    queue.add(batch_of(spark, *[change(f"f{i}.py", "added", i, "") for i in range(5)]))
    queue.add(batch_of(spark, change("z.py", "deleted", 1)))
    assert [r.file_path for r in queue.pending(2).collect()] == ["f0.py", "f1.py"]
    assert sorted(r.file_path for r in queue.consume(3).collect()) == ["f0.py", "f1.py", "f2.py"]
    assert [r.file_path for r in queue.pending().orderBy("seq").collect()] == ["f3.py", "f4.py", "z.py"]
    queue.mark(queue.pending(1))
    assert {r.change_type: r.n for r in queue.status().collect()} == {"added": 1, "deleted": 1}
    assert queue.clear() == 2 and queue.pending().count() == 0 and queue.consume(5).count() == 0


def test_supervision_starts_a_failed_stream_again(spark, tmp_path):
    landing, store = str(tmp_path / "landing"), Store(spark, str(tmp_path / "store"))
    loop.enqueue(spark, landing, [{"file_path": "a.py", "change_type": "added", "content": CODE.format("a")}])
    runner = loop.MaintenanceLoop(lambda: changes.watch(spark, landing, 1), store, str(tmp_path / "c"), loop.Config(wait=0.01, interval="100 milliseconds"))
    whole, left = runner._batch, [2]

    def shaky(df, number):
        if left[0]:
            left[0] -= 1
            raise OSError("shaky")
        whole(df, number)

    runner._batch = shaky
    assert runner.supervise(lambda: runner.metrics.processed > 0) == 2
    assert held(store) == {"a.py": ["a"]} and not runner.status()["running"] and runner.status()["last_file"] == "a.py"
