"""PII and toxicity: brute force for base spans, planted patterns, held-out accuracy, counterfactual pairs."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

from pyspark.sql import functions as F

from brindle.llm import pii, toxicity

random.seed(2)


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


PARTS = ["a", "b.c", "@", "@x.y", ".", "1", "22", "255", "256", "1.2.3.4", "+", "+1 (234) 555-1234", " ", "-", "4845168114407329", "é", "\n", "٣", "a@b.c", "0001", "("]


def test_base_spans():
    for _ in range(20_000):
        text = "".join(random.choice(PARTS) for _ in range(random.randint(0, 14)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_long_runs_are_linear():
    began = time.process_time()
    for text in ("9" * 300_000, "a" * 300_000, "a@" * 100_000, "1 " * 200_000, "+1" + " " * 300_000, "1." * 200_000):
        pii.candidates(text, pii.base_spans(text))
    assert time.process_time() - began < 10


def test_bootstrapping(spark, docs):
    card = "4845168114407329"
    texts = [f"please write to me at user{i}@mail.example.com about the thing of the day" for i in range(8)]
    texts += [f"please write to me at badge-77{i} about the order of the {i}{i}00{i} day" for i in range(3)]  # unseen identifiers behind the pattern
    texts += [f"all of the {w} went well and none of the others did" for w in ("dogs", "cats", "birds", "fish")]
    texts += [None, "", f"pay with {card} now", "of the 12345 nothing"]
    df = docs(texts, spans="clash")
    rows = {r.doc_id: r for r in pii.extract(df).collect()}
    assert len(rows) == len(texts)
    for i in range(3):
        found = [s for s in rows[8 + i].spans.split(",") if s.startswith("id:")]
        assert len(found) == 1 == rows[8 + i].n_id
        _, a, b = found[0].split(":")
        assert texts[8 + i][int(a) : int(b)] == f"badge-77{i}"
    assert rows[len(texts) - 1].spans == ""  # "of the" stands before ordinary words
    for i, t in enumerate(texts):
        base = pii.listed(brute_spans(t or ""))
        assert rows[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [s for s in rows[i].spans.split(",") if s and not s.startswith("id:")] == [s for s in base.split(",") if s]
    assert pii.extract(df.limit(0)).count() == 0 and pii.extract(df.unionByName(df)).count() == 2 * len(texts)


def test_contexts_and_tokens_of_any_length():
    long = "w" * 5000
    for n in (0, 1, 40, 5000):
        text = f"{'x' * n} {long}  \t{long} id-{'7' * n}1, (5) {long}"
        words = text.split()
        got = pii.candidates(text, [])
        assert [(text[a:b], p) for a, b, p, _, _ in got] == [(f"id-{'7' * n}1", " ".join(words[-5:-3] if n == 0 else words[1:3])), ("5", f"{long} id-{'0' * n}0,")]
    glued = "mail to:" + ",".join(f"u{i}@x.org" for i in range(3))
    assert {p for _, _, p, _, _ in pii.candidates(glued, pii.base_spans(glued))} == {"^ mail"}


def brute_reliable(texts):
    """The pattern-instance graph by dictionaries, in rounds until nothing changes."""
    edges, total, seeds = Counter(), Counter(), set()
    for t in texts:
        for _, _, pattern, instance, seed in pii.candidates(t, pii.base_spans(t)):
            edges[pattern, instance] += 1
            if seed:
                seeds.add(instance)
        words = ["^", "^", *re.sub("[0-9]", "0", t.lower()).split()]
        total.update(map(" ".join, zip(words, words[1:-1])))
    wide = {p for p, n in Counter(p for p, _ in edges).items() if n >= pii.SUPPORT}
    total = {p: max(total[p], sum(n for (q, _), n in edges.items() if q == p)) for p in wide}
    belief, before = {i: 100 for _, i in edges if i in seeds}, None
    while belief != before:
        before = dict(belief)
        of = {p: [(i, n) for (q, i), n in edges.items() if q == p] for p in wide}
        score = {p: sum(n * belief.get(i, 0) for i, n in of[p]) // total[p] for p in wide if sum(belief.get(i, 0) >= 50 for i, _ in of[p]) >= pii.SUPPORT}
        for p, r in score.items():
            for i, _ in of[p]:
                if i not in seeds:
                    belief[i] = max(belief.get(i, 0), r)
    return {p: r for p, r in score.items() if r >= 50}


def test_graph_against_brute_force(spark):
    draw = random.Random(5)
    heads = ["write to", "card no", "mail at", "of the", "ref is", "badge of"]
    texts = []
    for _ in range(400):
        i = draw.randrange(6)
        value = draw.choice([f"u{draw.randrange(40)}@x.org", f"id{draw.randrange(25)}", f"k-{draw.randrange(25)}", draw.choice(("dogs", "them", "you"))]) if i < 5 else f"id{draw.randrange(25)}"
        if draw.random() < (0.8, 0.7, 0.6, 0.1, 0.4, 0.0)[i]:
            value = f"u{draw.randrange(40)}@x.org" if i < 3 else f"id{draw.randrange(25)}"
        texts.append(f"so {heads[i]} {value} and on")
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    found = spark.createDataFrame([(p, i, s) for t in texts for _, _, p, i, s in pii.candidates(t, pii.base_spans(t))], "pattern string, instance string, seed boolean")
    got = {r.pattern: r.reliability for r in pii.reliable_patterns(found, frame).collect()}
    assert got == brute_reliable(texts) and len(got) >= 3


def test_occurrences_against_brute_force(spark):
    slot = lambda p: zlib.crc32(p.encode()) % pii.SLOTS
    names = ("".join(w) + " of" for w in itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=6))
    first = next(p for p in names if slot(p) == 0)  # the first and the last bit of a bucket
    last = next(p for p in names if slot(p) % 32768 == 32767)
    patterns = [first, last, "write to", "ticket no", "^ ^", "^ all", "never there"]
    texts = [f"all {first} them {last} him", "please write to me", "Write  TO\nyou", "ticket no 5 ticket no 6", "", "ticket no"] * 3
    brute = Counter()
    for t in texts:
        words = ["^", "^", *t.lower().split()]
        brute.update(p for p in map(" ".join, zip(words, words[1:-1])) if p in patterns)
    got = pii.occurrences(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    assert {r.pattern: r.total for r in got.collect()} == brute and len(brute) == 6


def test_seeds_before_ordinary_words_do_not_make_a_pattern_reliable(spark, docs):
    texts = [f"you may write to user{i}@mail.example.com" for i in range(4)] + ["you may write to them"] * 20 + ["you may write to badge-7700"]
    assert {r.n_id for r in pii.extract(docs(texts)).collect()} == {0}


INSULTS, WORDS = ("idiot", "moron", "scum"), [f"w{i}" for i in range(300)]


def labelled(n=900):
    rows = []
    for i in range(n):
        words = [random.choice(WORDS) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            words[7:7] = random.sample(INSULTS, 2)
        if random.random() < (0.9 if toxic else 0.1):  # a group is named with insults far more often
            words[20:20] = ["muslims"]
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_and_counterfactuals(spark):
    rows = labelled()
    df = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(None, "x", ""), (5000, None, ""), (5001, "", "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, None), (None, 1)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.classify(df, labels).collect()}
    truth = {i: y for i, _, y in rows}
    for i, r in out.items():
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [i for i in truth if out[i].held_out]
    assert sum(out[i].predicted == truth[i] for i in held) / len(held) > 0.97
    assert out[5000].score == out[5001].score == min(r.score for r in out.values()) or out[5001].predicted == 0


GROUPS = ("muslims", "juden", "femmes", "inmigrantes")


def biased(n=1200):
    """Toxic texts hold insults; some insults are rare, and groups are named with them far more often than in neutral texts."""
    draw, rows = random.Random(9), []
    for i in range(n):
        words = [draw.choice(WORDS) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            words[7:7] = [draw.choice(INSULTS) if draw.random() < 0.3 else f"slur{draw.randrange(400)}"]
        if toxic or draw.random() < 0.01:
            words[20:20] = [draw.choice(GROUPS)]
        rows.append((" ".join(words), int(toxic)))
    return rows


def model_of(rows, **how):
    return toxicity.fit([(y, 1.0, sorted(toxicity.features(w := toxicity.words_of(t))), [sorted(toxicity.features(o)) for o in toxicity.swapped(w)]) for t, y in rows], **how)


def score(model, text):
    return 1 / (1 + math.exp(-model.bias - sum(model.weights.get(f, 0) for f in toxicity.features(toxicity.words_of(text)))))


def test_counterfactuals_lower_false_positives_on_neutral_mentions():
    """At the weight that the query uses."""
    draw = random.Random(4)
    neutral = [" ".join([*(draw.choice(WORDS) for _ in range(25)), g]) for g in GROUPS for _ in range(50)]
    insulting = [" ".join([*(draw.choice(WORDS) for _ in range(25)), draw.choice(INSULTS)]) for _ in range(50)]
    free, held = model_of(biased(), counterfactual=0.0), model_of(biased())
    wrong = lambda m: sum(score(m, t) >= 0.5 for t in neutral) / len(neutral)
    assert wrong(free) > 0.5 and wrong(held) < 0.02
    assert sum(score(held, t) >= 0.5 for t in insulting) / len(insulting) > 0.9
    for g in GROUPS:  # a swap moves the score little
        gap = lambda m: max(abs(score(m, f"w1 {g}") - score(m, f"w1 {o}")) for o in toxicity.SWAP[g])
        assert gap(held) < 0.3 * gap(free)


def test_swaps():
    assert all(w not in others and len(set(others)) == len(others) for w, others in toxicity.SWAP.items() if len({w, *others}) == 1 + toxicity.SWAPS)
    assert toxicity.swapped({"a", "b"}) == [] and all("a" in s and "women" not in s for s in toxicity.swapped({"a", "women"}))


def test_repeated_rows_and_long_texts(spark):
    rows = labelled(300)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] * 2 + [(9999, "w1 " * 300_000 + "idiot"), (9998, "x" * 500_000)], "doc_id long, text string")
    out = toxicity.classify(df, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")).collect()
    assert len(out) == 602 and len({(r.doc_id, r.score) for r in out}) == 302


def test_degenerate_labels(spark, docs):
    df = docs(["a", "b"])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score < 0.01 for r in toxicity.classify(df, none).collect()} == {True}
    one = spark.createDataFrame([(i, 0) for i in range(2)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.classify(df, one).collect()} == {0}
    assert toxicity.classify(df.limit(0), one).count() == 0
    assert toxicity.held_out(F.lit(None).cast("long")) is not None


def test_every_feature_that_differs_takes_part(spark):
    """Toxic texts hold insults of three hundred, none of which tells more than another: none is left out."""
    draw, rows = random.Random(3), []
    for i in range(6000):
        words = [draw.choice(WORDS) for _ in range(8)]
        if i % 2:
            words += [f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{k:04d}slur" for k in ((3 * i + j) % 300 for j in range(30))]
        rows.append((i, " ".join(words), i % 2))
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, y int"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    slurs = {f for _, t, y in rows if y for w in t.split() if w.endswith("slur") for f in toxicity.word_features(w)[:1]}
    assert len(slurs) == 300 and slurs <= set(model.weights)
