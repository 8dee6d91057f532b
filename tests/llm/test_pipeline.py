"""The pipeline: each stage against brute force on a small fixture, and as a whole on the smallest tables."""

import itertools
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline as P
from brindle.llm import bpe, common, mixing, quality, secrets
from brindle.llm import queries as Q


def shingles(text, n=5):
    words = text.encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def pairs_alike(rows):
    """The cosine of every pair of shingle sets that share one."""
    held, shared = defaultdict(list), Counter()
    for i, s in rows.items():
        for x in s:
            held[x].append(i)
    for ids in held.values():
        shared.update(itertools.combinations(sorted(ids), 2))
    return {(a, b): n / (len(rows[a]) * len(rows[b])) ** 0.5 for (a, b), n in shared.items()}


def groups(rows, pairs):
    """The smallest id that each id reaches."""
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    root = {}
    for i in sorted(rows):
        todo = [i]
        while todo:
            a = todo.pop()
            if a not in root:
                root[a] = i
                todo += near[a]
    return root


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest tables hold no secret
    assert [n for n, _ in P.STAGES] == ["quality rules", "near-duplicates", "secret scan", "source mixing", "token ids"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = P.keep_quality(spark, docs, sf_dir)
    expected = {r.doc_id for r in docs.collect() if quality.judge(r.text or "")[0][6]}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == expected and kept.columns == docs.columns
    single = P.drop_near_duplicates(spark, kept, sf_dir)
    rows = {r.doc_id: shingles(r.text) for r in kept.collect()}
    stay, alike = {r.doc_id for r in single.select("doc_id").collect()}, pairs_alike(rows)
    assert single.columns == docs.columns and stay <= set(rows)
    # exactly, a document is left out if it is alike to one with a smaller id, in steps
    for similarity, share in ((0.9, 0.98), (0.8, 0.9)):
        twice = {max(p) for p, c in alike.items() if c >= similarity}
        assert len(twice - stay) >= share * len(twice) > 0
    loose = groups(rows, [p for p, c in alike.items() if c >= 0.55])
    assert all(i in stay for i, root in loose.items() if root == i) and all(loose[i] != i for i in set(rows) - stay)
    safe = P.redact_secrets(spark, single, sf_dir)
    assert safe.count() == single.count() and secrets.scan(safe).filter("is_secret").count() == 0 < secrets.scan(single).filter("is_secret").count()
    mixed = P.mix_sources(spark, safe, sf_dir)
    assert mixed.columns == docs.columns and mixed.count() == mixing.mix(safe).count()
    own = bpe.codec(bpe.VOCABULARY)
    texts = {r.doc_id: r.text for r in safe.collect()}
    for r in P.tokenize(spark, mixed, sf_dir).collect():
        assert own.decode(r.ids) == texts[r.doc_id]


def test_run_and_registered_names(spark, sf_dir):
    out = P.run(spark, sf_dir)
    assert out.columns == ["doc_id", "ids"] and out.count() > 0
    names = [n for n in Q.queries()]
    assert names[-1] == "pipeline" and [int(n[2:].split("_")[0]) for n in names[:-1]] == list(range(1, 14))


HARD = [None, "", " \t", "one", "word " * 3000, "\n".join(" ".join(f"stone{i * j % 97}" for j in range(1, 21)) + "." for i in range(1, 7))]
CLASH = ("copy", "shuffle_key", "__text", "__parts", "c0", "c7", "id", "hash", "own", "number", "row")


def test_stages_on_hard_rows(spark, docs, sf_dir):
    df = docs([*HARD, HARD[-1], HARD[-1].replace("stone", "cloud")])
    df = df.unionByName(df.filter("doc_id = 5")).unionByName(df.filter("doc_id >= 6").withColumns({"doc_id": F.lit(None).cast("long"), "source": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")}))
    for c in CLASH:
        df = df.withColumn(c, F.lit(f"own {c}"))
    out = df
    sizes = []
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, df.limit(0), sf_dir).count() == 0
        out = common.stored(stage(spark, out, sf_dir), "hard")
        assert out.columns == df.columns
        assert all(r[c] == f"own {c}" for r in out.collect() for c in CLASH)
        sizes.append(out.count())
    assert sizes[:3] == [6, 2, 2]  # three rows of each text with words, then one
    assert P.tokenize(spark, out, sf_dir).count() == out.count() and P.tokenize(spark, df.limit(0), sf_dir).count() == 0


def test_scratch_removes_what_a_stage_wrote(spark, docs):
    import os

    with common.scratch(spark):
        inside = common.shared_path(spark, "t")
        docs(["a"]).write.parquet(inside)
    assert not os.path.exists(inside)
    outside = common.shared_path(spark, "t")
    docs(["a"]).write.parquet(outside)
    assert os.path.exists(outside)


def test_no_shared_folder_off_a_local_master(spark, monkeypatch):
    import pytest

    from brindle import session

    class Context:
        master = "spark://somewhere"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError):
        session.shared_root(Session())
