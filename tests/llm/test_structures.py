"""Conversation trie, packing and Merkle manifest against brute force, with the hard rows of each."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.llm import merkle, packing, trie
from brindle.llm.tokenbin import END_ID, VOCABULARY

TALK = "conv_id long, turn long, role string, text string"


def brute_trie(rows, share=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h, donor = zlib.crc32(str(c).encode()) % 9, c - int(math.fmod(c, 5))
        whole[c] = tuple(own.get(donor, [])[:h] + v[h:]) if share else tuple(v)
    members, children, leaves, saved, out = defaultdict(list), defaultdict(set), {}, {}, set()
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                children[s[: d - 1]].add(s[:d])
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in children[s]) or 1
        saved[s] = sum(saved[k] for k in children[s]) + ((len(members[s]) - 1) * len(s[-1][1].encode()) if s else 0)
    for s, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(s))
        out.add((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children[s]), leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def talks():
    pick, rows = random.Random(3), []
    for c in [*range(-12, 60), 10**12, 10**12 + 3]:
        if c % 11 == 4:
            continue
        first = pick.choice(["hello", "guten Tag", "", None])
        for t in range(pick.randint(0, 5) if c % 7 else 12):
            rows.append((c, t, pick.choice(["user", None]), first if t == 0 else pick.choice("abé")))
    rows += [(c, t, "user", f"copy {t}") for c in range(100, 160) for t in range(20)]  # copies
    rows += [(200 + c, t, "user", f"long {t}" if t < 17 else f"own {c}") for c in range(3) for t in range(18)]  # alike for two blocks
    rows += [(7, None, "user", "no number"), (7, None, "user", "no number"), (7, 1, "b", "tie"), (7, 1, "a", "tie"), (7, 1, "a", "tia"), (None, 0, "user", "lost")]
    return rows


@pytest.mark.parametrize("share", [True, False])
def test_trie_is_that_of_brute_force(spark, share):
    rows = talks()
    df = spark.createDataFrame(rows, TALK).withColumns({"digest": F.lit(1), "node": F.lit("x"), "depth": F.lit(3)}).repartition(5)
    got = [tuple(r) for r in (trie.shared_prefix_trie if share else trie.prefix_trie)(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_trie(rows, share)


def test_trie_of_nothing_and_of_one(spark):
    assert trie.shared_prefix_trie(spark.createDataFrame([], TALK)).count() == 0
    assert trie.shared_prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], TALK)).count() == 0
    for rows in ([(3, 0, "user", "x")], [(5, 0, None, None), (5, 0, None, None)]):
        assert {tuple(r) for r in trie.shared_prefix_trie(spark.createDataFrame(rows, TALK)).collect()} == brute_trie(rows)


def test_hash_of_many_copies_crosses_runs(spark):
    n = 2 * trie.RUN + 5
    rows = spark.range(n).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("same").alias("text"))
    got = {r.depth: r for r in trie.prefix_trie(rows).collect()}
    assert got[1].n_convs == n and got[1].ends_sha256 == hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest()
    assert got[0].ends_sha256 == trie.NOBODY and got[0].saved_tokens == 4 * (n - 1) and len(got) == 2


def brute_merkle(rows, fan=8):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaf = lambda r: digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r.doc_id, r.source, r.lang, r.n_chars, r.text)))

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([digest("".join(levels[-1][i : i + fan])) for i in range(0, len(levels[-1]), fan)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            start = i // fan * fan
            yield "".join(level[start:i]), "".join(level[i + 1 : start + fan])
            i //= fan

    groups, out = defaultdict(list), []
    for r in rows:
        groups[r.lang].append(((r.doc_id is not None, r.doc_id or 0, leaf(r)), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    members = {g: sorted(groups[g], key=lambda x: x[0]) for g in names}
    trees = {g: tree([k[2] for k, _ in members[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    for at, g in enumerate(names):
        for i, (k, r) in enumerate(members[g]):
            steps = [*path(trees[g], i), *path(top, at)]
            folded = k[2]
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None:
                folded = leaf(type(r)(**(r.asDict() | {"text": "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)})))
            for before, after in steps:
                folded = digest(before + folded + after)
            root = top[-1][0]
            out.append((r.doc_id, k[2], trees[g][-1][0], root, digest("".join(b + a for b, a in steps)), folded, folded == root))
    return out


def test_manifest_is_that_of_brute_force(spark):
    big = [(i, None if i % 5 else "s", "en", i, f"Text {i} É") for i in range(9000)]  # three buckets and two tiers
    few = [(i, "s", "de", None, "Über") for i in range(65)] + [(i, "s", None, 1, "n") for i in range(8)] + [(i, "s", "", 1, "e") for i in range(9)]
    odd = [(None, None, None, None, None), (None, "a", "fr", 1, "Zwei"), (4, "a", "fr", 1, "Zwei"), (4, "a", "fr", 1, "Zwei"), (4, "b", "fr", 1, "A" * 100_000), (-3, "s", "zz", 2, "")]
    langs = [(i, "s", f"l{i:03}", 1, "Own") for i in range(70)]
    df = spark.createDataFrame(big + few + odd + langs, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.tamper_check(df.withColumns({"i": F.lit(1), "tree": F.lit("x"), "h": F.lit("y")}).repartition(7)).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute_merkle(df.collect()), key=key)
    assert any(not r.verified for r in got) and merkle.tamper_check(df.limit(0)).count() == 0


def test_manifest_proofs_as_text(spark, docs):
    df = docs(["a", "b", None, ""] * 5)
    rows = merkle.build(df, claimed=F.when(F.col("doc_id") == 7, F.lit("0" * 64))).proofs(whole=True).collect()
    assert [r.doc_id for r in rows if not r.verified] == [7]
    assert all(hashlib.sha256(r.proof.encode()).hexdigest() == r.proof_sha256 for r in rows) and len({r.root for r in rows}) == 1


def fewest(lengths, capacity):
    """The least number of bins, by trying all."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= capacity and bins[b] not in bins[:b]:
                place(i + 1, [*bins[:b], bins[b] + lengths[i], *bins[b + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bounds_and_best_fit_around_the_fewest(lengths):
    lengths = sorted(lengths, reverse=True)
    bins = packing.best_fit_decreasing(np.array(lengths), 20)
    fill = np.bincount(bins, weights=lengths)
    assert fill.max() <= 20 and fill.min() > 0
    room, plain = [], []  # one item after the other
    for x in lengths:
        at = min((i for i in range(len(room)) if room[i] >= x), key=lambda i: room[i], default=len(room))
        room[at:at] = [20] if at == len(room) else []
        room[at] -= x
        plain.append(at)
    assert sorted(20 - fill) == sorted(room)
    bound, least = packing.lower_bound(np.bincount(lengths, minlength=21), 20), fewest(lengths, 20)
    assert bound <= least <= len(room)


def valid(rows, capacity):
    by, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.piece, r.start, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= capacity
    return by, docs


def test_sequences_hold_every_document_whole(spark, docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(VOCABULARY)
    texts = [None, "", "word", "wörter und mehr " * 40, "x" * 50_000, "a b " * 3000, " ".join(map(str, range(700))), *(f"short text {i}" * (i % 9 + 1) for i in range(150))]
    df = docs(texts, row="clash", bin=1, group="g")
    rows = packing.sequences(df)[0].collect()
    _, by_doc = valid(rows, packing.CAPACITY)
    crc = {(r.doc_id, r.piece): r.ids_crc32 for r in rows}
    for i, text in enumerate(texts):
        ids = own.encode(text or "", add_special_tokens=False).ids + [END_ID]
        parts = sorted(by_doc[i])
        assert [p for p, _, _ in parts] == list(range(-(-len(ids) // packing.CAPACITY))) and all(n == packing.CAPACITY for _, _, n in parts[1:])
        assert [s for _, s, _ in parts] == [sum(n for _, _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, _, n in parts) == len(ids)
        for p, s, n in parts:
            assert crc[i, p] == zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())
    again = docs(texts[:20])
    assert packing.sequences(again.unionByName(again))[0].count() == 2 * packing.sequences(again)[0].count()
    assert packing.sequences(df.limit(0))[0].count() == 0


def test_exchanges_come_down_to_the_bound(spark):
    pick = np.random.default_rng(5)
    lengths = pick.integers(1, 1024, 6000).tolist()
    items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "row long, length long")
    rows, history = packing.packed(items, group=500)
    fill = defaultdict(int)
    for r in rows.collect():
        fill[r.bin] += r.length
    bins = [b for b, _ in history]
    assert bins == sorted(bins, reverse=True) and bins[-1] < bins[0] and len(fill) == bins[-1] and max(fill.values()) <= 1024
    assert sum(fill.values()) == sum(lengths) and rows.count() == 6000
    at_once = int(packing.best_fit_decreasing(np.array(lengths)).max()) + 1
    assert bins[-1] <= 1.005 * at_once and history[-1][1] <= at_once
    same, counts = packing.packed(spark.createDataFrame([(i, 1 + 512 * (i % 2)) for i in range(2000)], "row long, length long"), group=100)
    assert counts[-1] == (1000, 1000) and same.select("bin").distinct().count() == 1000
