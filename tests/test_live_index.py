"""The index that follows changes against one that is built anew after each batch."""

import random

from pyspark.sql import functions as F

from brindle.operators import live_index, search
from brindle.sources.sinks import Store

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa Straße the".split()
QUESTIONS = ("alpha beta alpha", "straße kappa", "the", "nowhere zeta")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def answers(index, question):
    return {r.key: round(r.score, 6) for r in index.scores(question).collect()}


def test_random_batches_equal_an_index_built_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live_index, "FANOUT", 2)
    draw, held, store = random.Random(5), {}, Store(spark, str(tmp_path / "s"))
    for number in range(5):
        keys = draw.sample(range(30), 25 if not number else 6)
        went = draw.sample(range(40), 5) if number else []
        batch = {k: None if draw.random() < 0.1 else " ".join(draw.choices(WORDS, [9, 5, 3, 2, 1, 1, 1, 1, 1, 1, 1, 9], k=draw.randint(0, 12))) for k in keys}
        live_index.apply(store, docs_of(spark, list(batch.items())), docs_of(spark, [(k, None) for k in went]).select("doc_id"), batch=number)
        held = {k: t for k, t in held.items() if k not in went} | batch
        if number in (2, 4):
            whole = search.build_index(docs_of(spark, list(held.items())), str(tmp_path / f"i{number}"))
            live = live_index.LiveIndex(spark, store.root)
            for question in QUESTIONS if number == 4 else QUESTIONS[:1]:
                assert answers(live, question) == answers(whole, question)
            frequencies = lambda i: {(r.term, r.df) for r in i.table("terms").collect()}
            assert frequencies(live) == frequencies(whole)
            assert [tuple(r) for r in live.top("beta alpha", 4).collect()] == [tuple(r) for r in whole.top("beta alpha", 4).collect()]
    # five batches in tiers of two: four in one segment and one that waits
    assert live_index.segments(store) == [(3, 2), (4, 0)]


def test_a_batch_writes_its_own_segment_alone_and_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    live_index.apply(store, docs_of(spark, [(i, f"alpha w{i}") for i in range(200)]), batch=0)
    before = dict(store._manifest()["tables"][live_index.POSTINGS]["parts"])
    changed = docs_of(spark, [(3, "beta"), (3, "alpha"), (None, "alpha"), (900, None)])
    for _ in range(2):  # a retry of the batch
        live_index.apply(store, changed, docs_of(spark, [(4, None), (3, None), (77777, None)]).select("doc_id"), batch=1)
    now = store._manifest()["tables"][live_index.POSTINGS]["parts"]
    assert before.items() <= now.items() and len(now) == 2
    index = live_index.LiveIndex(spark, store.root)
    assert tuple(index.table("stats").first()) == (200, 397 / 200)
    assert {r.term: r.df for r in index.table("terms").filter(F.col("term").isin("alpha", "beta", "w3", "w4", "w5")).collect()} == {"alpha": 198, "beta": 1, "w5": 1}
    assert [r.key for r in index.top("beta", 1).collect()] == [3]


def test_an_index_that_loses_all_its_documents(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = docs_of(spark, [(1, "alpha beta"), (2, "alpha"), (3, None)])
    live_index.apply(store, rows.limit(0))
    assert live_index.LiveIndex(spark, store.root).top("alpha", 3).count() == 0
    live_index.apply(store, rows)
    live_index.apply(store, rows.limit(0), rows.select("doc_id"))
    index = live_index.LiveIndex(spark, store.root)
    assert index.top("alpha", 3).count() == 0 and index.scores("alpha").count() == 0 and index.table("terms").count() == 0
    for _ in range(2):  # a batch without rows made no segment
        live_index.apply(store, rows)
    assert live_index.segments(store) == [(3, 1)] and store.read(live_index.DEAD).count() == 0
    assert [r.key for r in live_index.LiveIndex(spark, store.root).top("beta", 1).collect()] == [1]


def test_postings_are_sorted_by_term_in_each_file(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    live_index.apply(store, docs_of(spark, [(i, " ".join(f"w{(i * 7 + j) % 300:03d}" for j in range(20))) for i in range(300)]))
    rows = store.read(live_index.POSTINGS).select("term", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("at")).collect()
    files = {}
    for r in sorted(rows, key=lambda r: r["at"]):
        files.setdefault(r.f, []).append(r.term)
    assert sum(map(len, files.values())) == 6000 and all(terms == sorted(terms) for terms in files.values())


def test_the_loop_keeps_the_index_of_its_symbols(spark, tmp_path):
    from test_delta import step

    from brindle.functions.structure import extract
    from brindle.operators import graph as G
    from brindle.plans import retrieval
    from brindle.streaming import loop

    store, config, files = Store(spark, str(tmp_path / "s")), loop.Config(keywords=True), {}
    batches = [{"a.py": "def read_token():\n    open_file()\n", "b.py": "def open_file():\n    pass\n"}, {"a.py": None, "b.py": "def open_file():\n    token = 1\n", "c.py": "class Token:\n    pass\n"}]
    for number, batch in enumerate(batches):
        files |= batch
        loop.apply_changes(store, step(spark, number, files, batch), config, batch=number)
        whole = retrieval.build_index(G.build(extract(spark.createDataFrame([(p, c) for p, c in files.items() if c], "path string, content string"))), str(tmp_path / f"i{number}"))
        assert answers(live_index.LiveIndex(spark, store.root), "token open_file") == answers(whole, "token open_file")
