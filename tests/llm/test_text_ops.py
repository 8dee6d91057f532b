"""Quality rules, SimHash, BPE, token segments: brute force, exact round trips, edge cases."""

import itertools
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brindle.llm import bpe, quality, simhash, tokenbin

random.seed(11)
CLEAN = "\n".join(" ".join(f"{random.choice(('river', 'stone', 'cloud', 'field', 'light'))}{random.randint(0, 99)}" for _ in range(20)) + "." for _ in range(6))
HARD = [None, "", " \t\n", "one", CLEAN, CLEAN, "é" * 5000, "word " * 3000, "\x1c a\x85b", "<|endoftext|> x<|endoftext|>"]


# quality ---------------------------------------------------------------------------------------------------------------


def brute_repeats(words, window=8):
    wins = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    return len({j for i, w in enumerate(wins) if wins.count(w) > 1 for j in range(i, i + window)})


def test_repeated_words():
    for _ in range(300):
        words = [random.choice("ab") if random.random() < 0.8 else str(random.random()) for _ in range(random.randint(0, 40))]
        assert quality.repeated_words(words) == brute_repeats(words)


def test_quality_verdicts(spark, docs):
    texts = [*HARD, " | ".join(["Home", "News", "About us"] * 12), "Buy### now$$$ cheap%%% " * 30, CLEAN + "\nAll rights reserved.", "HEY!! YOU!! THERE!! " * 20, "\n".join(["Sign up", "Log in", "Menu"] * 10) + "\n" + CLEAN[:150]]
    got = {r.doc_id: r for r in quality.assess(docs(texts, kept="clash")).collect()}
    n = len(HARD)
    assert got[4].kept and got[5].kept and got[n + 2].kept
    assert not any(got[i].kept for i in (0, 1, 2, 3, 6, 7, n, n + 1, n + 3, n + 4))
    assert (got[0].n_words, got[1].n_words, got[2].n_words) == (0, 0, 0) and got[7].n_repeat_words == 3000
    assert got[8].n_words == 2 and got[8].word_chars == 4  # \x1c and \x85 are no word breaks here
    assert got[n + 1].n_symbols == 9 * 30


def test_quality_clean(spark, docs):
    df = docs([CLEAN + "\nHome | News | About", None, "short"], n_words=7)
    (row,) = quality.clean(df).collect()
    assert row.text == CLEAN and row.n_chars == len(CLEAN) and row.n_words == 7
    assert quality.clean(df.limit(0)).count() == 0 and quality.clean(df.unionByName(df)).count() == 2


# near-duplicates ---------------------------------------------------------------------------------------------------------


def brute_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate({i: " " for i in range(9, 14)}).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(prints))]


def test_fingerprints():
    for text in ["", " ", "a", "A b", "a B  c\td", CLEAN, "É À É à " * 9, "x\x85y z w"]:
        assert simhash.fingerprint(text) == brute_print(text)


def test_same_hash_as_spark(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("bucket", [simhash.LARGE_BUCKET, 1])
def test_links_find_all_pairs(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "LARGE_BUCKET", bucket)
    base = [random.getrandbits(64) for _ in range(20)]
    prints = {0, 2**64 - 1}
    for b in base:
        for _ in range(20):
            prints.add(b ^ sum(1 << i for i in random.sample(range(64), random.randint(0, 4))))
        prints |= {(b & ~0xFFFFFFFF) | random.getrandbits(32) for _ in range(5)}
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    got = {tuple(sorted((r.a, r.b))) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    expected = {tuple(sorted((a, b))) for a, b in itertools.combinations(signed, 2) if ((a ^ b) % 2**64).bit_count() <= 3}
    assert got == expected


def shingles(text, n=5):
    words = text.encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def cosine(a, b):
    return 1.0 if a == b else len(a & b) / (len(a) * len(b)) ** 0.5 if a and b else 0.0


def copies(rng, n, share):
    """A text of ``n`` words, and a copy in which each word is another one with the given chance."""
    words = [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    return " ".join(words), " ".join(f"x{rng.randint(0, 5000)}" if rng.random() < share else w for w in words)


def node(text, i):
    return i, [int(x) for x in simhash.segments(text)]


NODES = "fp long, segments array<long>"


def test_alike_finds_what_is_alike(spark):
    rng = random.Random(8)
    pairs = [copies(rng, rng.randint(80, 500), rng.choice((0.005, 0.02, 0.03, 0.04, 0.12))) for _ in range(400)]
    nodes = [node(t, 2 * i + k) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    got = {(r.a, r.b) for r in simhash.alike(spark.createDataFrame(nodes, NODES)).collect()}
    alike = {i: cosine(*map(shingles, p)) for i, p in enumerate(pairs)}
    assert all(b == a + 1 and a % 2 == 0 for a, b in got)  # unlike texts never meet
    found = lambda low, high: [(2 * i, 2 * i + 1) in got for i, c in alike.items() if low <= c < high]
    recall = lambda x: sum(x) / len(x)
    assert recall(found(0.8, 1.1)) >= 0.9 and recall(found(0.9, 1.1)) >= 0.98 and not any(found(0.0, 0.58))


def test_crowds_stay_connected_with_few_links(spark):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
    counts = {}
    for n in (200, 800):
        group = [" ".join(f"x{rng.randint(0, 5000)}" if rng.random() < 0.01 else w for w in base) for _ in range(n)]
        others = [" ".join(f"y{rng.randint(0, 5000)}" for _ in range(100)) for _ in range(40)]
        links = simhash.alike(spark.createDataFrame([node(t, i) for i, t in enumerate([*group, *others])], NODES))
        assert {r.node: r.root for r in simhash.components(links).collect()} == {i: 0 for i in range(1, n)}
        counts[n] = links.count()
    assert counts[800] < 6 * counts[200]  # in proportion to the group, not to its square


def test_crowds_leave_no_group_apart(spark, monkeypatch):
    """Components are those of all pairs that meet, whatever the size of a crowd."""
    rng = random.Random(12)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(200)]
        for _ in range(3):  # copies of copies: groups that hang together by few pairs
            base = [f"x{rng.randint(0, 3000)}" if rng.random() < 0.03 else w for w in base]
            texts += [" ".join(f"x{rng.randint(0, 3000)}" if rng.random() < 0.02 else w for w in base) for _ in range(15)]
    nodes = spark.createDataFrame([node(t, i) for i, t in enumerate(texts)], NODES)
    found = []
    for crowd in (10_000, 8, 2):
        monkeypatch.setattr(simhash, "CROWD", min(crowd, 300))
        found.append({r.node: r.root for r in simhash.components(simhash.alike(nodes)).collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) > 200


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 900), (900, 700)]
    random.shuffle(edges)
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {700: 500, 900: 500}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_in_a_crowd_are_cut_to_the_last_byte(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE_BUCKET", 8)
    base = random.getrandbits(64)
    prints = sorted({base ^ sum(1 << i for i in c) for n in range(4) for c in itertools.combinations(range(0, 64, 5), n)})[::3] + [base ^ 255, base ^ (7 << 8)]
    prints = sorted(set(prints))
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    got = [tuple(sorted((r.a, r.b))) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()]
    expected = {tuple(sorted((a, b))) for a, b in itertools.combinations(signed, 2) if ((a ^ b) % 2**64).bit_count() <= 3}
    assert set(got) == expected and len(got) == len(expected)


def test_one_row_of_each_group_stays(spark):
    words = [f"w{random.randint(0, 400)}" for _ in range(300)]
    a, b, c = " ".join(words), " ".join(["changed", *words[1:]]), "other words entirely for this text here"
    assert brute_components([brute_print(a), brute_print(b)]) == [0, 0]
    rows = [(1, a, "x"), (1, c, "x"), (1, a, "y"), (2, a, "x"), (3, b, "x"), (None, c, "z"), (None, "only here without any name at all", "z"), (None, None, "p"), (None, "", "o"), (4, c, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __note string").withColumn("extra", F.create_map(F.lit("k"), F.lit(1)))
    got = sorted(((r.doc_id, r.text, r["__note"]) for r in simhash.keep_one(df).collect()), key=repr)
    assert got == sorted([(1, a, "x"), (1, c, "x"), (None, "only here without any name at all", "z"), (None, "", "o")], key=repr)
    assert simhash.keep_one(df).columns == df.columns and simhash.keep_one(df.limit(0)).count() == 0


def test_hubs_and_hot_groups_are_dealt(spark, monkeypatch):
    edges = spark.createDataFrame([(0, i) for i in range(1, 400)] + [(400 + i, 900 + i) for i in range(50)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 400)} | {900 + i: 400 + i for i in range(50)}
    rows = spark.createDataFrame([(1, i) for i in range(100)] + [(k, k) for k in range(2, 40)], "fp long, v long")
    names = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("best"))
    for hot in (1000, 3, 1):
        monkeypatch.setattr(simhash, "HOT", hot)
        out = simhash._named(rows, names, "fp")
        assert sorted(map(tuple, out.select("fp", "v", "best").collect())) == sorted((f, v, 99 if f == 1 else f) for f, v in [(1, i) for i in range(100)] + [(k, k) for k in range(2, 40)])


def test_very_long_texts(monkeypatch):
    text = " ".join(f"w{i % 997}" for i in range(2 * simhash.CHUNK + 500))
    assert simhash.fingerprint(text) == brute_print(text)


def test_near_duplicates(spark, docs):
    words = [f"w{random.randint(0, 400)}" for _ in range(300)]
    near = [" ".join(words[:i] + ["changed"] + words[i + 1 :]) for i in (3, 150, 299)]
    texts = [" ".join(words), *near, *HARD, "other words entirely for this text here"]
    df = docs(texts, component_id="clash")
    rows = simhash.near_duplicates(df.unionByName(df)).collect()
    assert len(rows) == 2 * len(texts)
    prints = [brute_print(t or "") for t in texts]
    expected = brute_components(prints)
    for r in rows:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == expected[r.doc_id]
    kept = simhash.keep_one(df).collect()
    groups = set(expected) - {1, 2, 3}  # a word changed in 300, whatever its fingerprint's distance
    assert sorted(r.doc_id for r in kept) == sorted(groups)
    assert simhash.keep_one(df).columns == df.columns and simhash.near_duplicates(df.limit(0)).count() == 0
    nameless = df.withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id")))
    assert simhash.near_duplicates(nameless).filter("component_id is null").count() == 4
    assert simhash.keep_one(nameless).count() == len(groups)


# tokens ------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.VOCABULARY)


def fuzz(n):
    parts = [" ", "  ", "\n", "\t", "foo", "'s", "é", "12", "<|endoftext|>", " ", "\x1c", "​", "!", "don't", "\r\n", ".", "\x85", "ǅ", "日本", "🙂", "###", "_"]
    return ["".join(random.choice(parts) for _ in range(random.randint(0, 9))) for _ in range(n)]


def test_bpe_is_the_library(library):
    own = bpe.Codec(bpe.VOCABULARY)
    for text in [*fuzz(5000), "x" * 20000, *filter(None, HARD)]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert own.decode([128]) == library.decode([128], skip_special_tokens=False)  # part of a character


def test_bpe_columns(spark, docs, library):
    df = docs(HARD, ids="clash")
    ids = bpe.encode(df)
    assert {r.doc_id: r.ids for r in ids.collect()} == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(HARD)}
    assert {r.doc_id: r.text for r in bpe.decode(ids).collect()} == {i: t or "" for i, t in enumerate(HARD)}
    assert {r.doc_id: r.n_tokens for r in bpe.digests(df).collect()}[0] == 0 and bpe.digests(df.limit(0)).count() == 0


def test_bpe_of_repeated_rows(spark, docs):
    df = docs([*HARD, "x " * 100_000])
    once, twice = ([tuple(r) for r in bpe.digests(x).collect()] for x in (df, df.unionByName(df)))
    assert sorted(once * 2) == sorted(twice) and set(once) == set(twice)


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 10)
    own = bpe.Codec(bpe.VOCABULARY)
    for i in range(50):
        own.encode(f"word{i} other")
    assert len(own) <= 10


def test_pack_round_trip():
    rng = np.random.default_rng(3)
    for n, high in itertools.product((0, 1, 255, 256, 257, 5000), (1, 2, 1000, 50257, 2**32)):
        ids = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
        ids[::37] = high - 1
        starts, data = tokenbin.pack(ids)
        assert (tokenbin.unpack(starts, data, n) == ids).all()
    skewed = np.where(rng.random(10_000) < 0.95, rng.integers(0, 16, 10_000), 50_000).astype(np.uint32)
    assert len(tokenbin.pack(skewed)[1]) < 1.3 * len(skewed)  # exceptions don't widen their blocks
    starts, data = tokenbin.pack(skewed)
    some = tokenbin.unpack(starts[10:12] - starts[10], data[int(starts[10]) :], 256)
    assert (some == skewed[2560:2816]).all()  # one block, found by the index


def test_library_encoder(library):
    import pyarrow as pa

    own = tokenbin.LibraryEncoder(tokenbin.VOCABULARY)
    texts = [*fuzz(5000), "x" * 20000, *filter(None, HARD)]
    ids, lengths = own.encode(pa.array(texts), 2)
    for text, part in zip(texts, np.split(ids, np.cumsum(lengths)[:-1])):
        assert part.tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("segment", [1 << 19, 3])
def test_token_files(spark, docs, library, monkeypatch, segment):
    monkeypatch.setattr(tokenbin, "SEGMENT_IDS", segment)
    df = docs([*HARD, *fuzz(300)], start="clash").repartition(3)
    rows = sorted(tokenbin.round_trip(df).collect(), key=lambda r: r.start)
    at = 0
    for i, r in enumerate(rows):
        text = df.filter(F.col("doc_id") == i).first().text if i < len(HARD) else None
        assert r.doc_id == i and r.start == at
        at += r.n_tokens
        if i < len(HARD):
            ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
            assert r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert tokenbin.round_trip(df.limit(0)).count() == 0
    twice = tokenbin.round_trip(df.unionByName(df).withColumn("doc_id", F.when(F.col("doc_id") > 5, F.col("doc_id")))).orderBy("start").collect()
    assert [r.doc_id for r in twice][:12] == [None] * 12 and len(twice) == 2 * len(rows)
