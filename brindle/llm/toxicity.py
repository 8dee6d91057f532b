"""Toxicity: a linear classifier regularised by counterfactuals.

Features of a text are its different words and their beginnings, as 64-bit hashes. Labelled texts that name a group also
give their features with every identity term swapped for others, several times; the loss holds the squared change of the
logit under each swap, so that naming a group moves the score little whatever the labels say.

Training takes a bounded sample of labelled rows (``MAX_ROWS`` of each class, those with the least hash). Features are
counted by a distributed aggregation over the sample; all whose shares differ significantly between the classes take part,
however many they are, and the lasso chooses among them. Scoring is one narrow pass over all whole texts with the weights.

Defined results: a null or empty text scores as a text without features; rows with a null key are never held out and
never learnt from; several labels of a key count as toxic if one is, null labels are none; without rows of both classes
every score is the share of toxic rows (0 without rows); repeated rows are scored each; extra columns never enter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, text_of

#: Labelled rows of each class, and rows of a feature at least.
MAX_ROWS, MIN_ROWS = 10_000, 5
#: A feature takes part if its shares among toxic and other rows differ by this many standard errors.
MIN_Z = 6.0
THRESHOLD = 0.7
#: Weights of the counterfactual, the lasso and the ridge term; steps of the optimiser.
COUNTERFACTUAL, LASSO, RIDGE, STEPS = 2.0, 3e-5, 1e-4, 800
PREFIXES = (4, 5, 6)
CACHED_WORDS, CUT_ROWS = 200_000, 256
FOLDS, HELD_OUT = 3, 1

#: Identity terms in English, German, French and Spanish; each stands for any other of its row.
IDENTITY = (
    "women men girls boys females males mothers fathers transgender nonbinary",
    "woman man girl boy female male mother father",
    "gay lesbian bisexual straight queer heterosexual homosexual",
    "muslim christian jewish hindu buddhist atheist catholic sikh",
    "muslims christians jews hindus buddhists atheists catholics sikhs",
    "black white asian latino african european american mexican chinese arab indian",
    "immigrant refugee foreigner native citizen",
    "immigrants refugees foreigners natives citizens",
    "old young disabled blind deaf",
    "frauen männer mädchen jungen mütter väter",
    "muslime christen juden hindus buddhisten atheisten katholiken",
    "schwule lesben heterosexuelle",
    "einwanderer flüchtlinge ausländer einheimische",
    "femmes hommes filles garçons mères pères",
    "musulmans chrétiens juifs hindous bouddhistes athées catholiques",
    "immigrés réfugiés étrangers citoyens",
    "mujeres hombres niñas niños madres padres",
    "musulmanes cristianos judíos hindúes budistas ateos católicos",
    "inmigrantes refugiados extranjeros ciudadanos",
)
#: Swaps that a text which names a group is given with: each term for that many others of its row.
SWAPS = 3
SWAP: dict[str, tuple[str, ...]] = {}
for _row in map(str.split, IDENTITY):
    for _i, _w in enumerate(_row):
        SWAP.setdefault(_w, tuple(_row[(_i + _k * (len(_row) - 1) // SWAPS + 1) % len(_row)] for _k in range(SWAPS)))
WORD = re.compile(r"\w+")


def word_features(word: str) -> tuple[int, ...]:
    """The features of one word: the word, and its beginnings where it is longer."""
    digest = xxhash.xxh3_64_intdigest
    return (digest(word) >> 1, *(digest(f"{word[:n]}*") >> 1 for n in PREFIXES if len(word) >= n))


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features(words: set[str]) -> set[int]:
    return {f for w in words for f in word_features(w)}


def swapped(words: set[str]) -> list[set[str]]:
    """The words with every identity term swapped, once for each of ``SWAPS``; none where no group is named."""
    return [{SWAP[w][k] if w in SWAP else w for w in words} for k in range(SWAPS)] if not words.isdisjoint(SWAP) else []


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


@dataclass(frozen=True)
class Model:
    weights: dict[int, float]
    bias: float


def fit(rows: list[tuple[int, float, list[int], list[list[int]]]], counterfactual: float = COUNTERFACTUAL, steps: int = STEPS) -> Model:
    """A model from (label, weight of the row, features, features after each swap).

    Accelerated proximal gradient on the weighted logistic loss, the mean squared change of the logit over swapped rows, ridge and lasso.
    """
    label = np.array([r[0] for r in rows], float)
    weight = np.array([r[1] for r in rows], float)
    if not len(rows) or label.min() == label.max():
        share = float(np.average(label, weights=weight)) if len(rows) else 0.0
        return Model({}, float(np.log(np.clip(share, 1e-9, 1 - 1e-9) / (1 - np.clip(share, 1e-9, 1 - 1e-9)))))
    weight /= weight.sum()
    names = sorted({f for r in rows for part in (r[2], *r[3]) for f in part})
    at = {f: i for i, f in enumerate(names)}
    row = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    col = np.array([at[f] for r in rows for f in r[2]], int)
    pairs = [(sorted(set(r[2]) - set(other)), sorted(set(other) - set(r[2]))) for r in rows for other in r[3]]
    pairs = [p for p in pairs if p[0] or p[1]]
    pair_row = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs])
    pair_col = np.array([at[f] for a, b in pairs for f in (*a, *b)], int)
    pair_sign = np.array([s for a, b in pairs for s in [1.0] * len(a) + [-1.0] * len(b)], float)
    # curvature bounds each step: rows with many features pull hard
    degree = np.bincount(row, minlength=len(rows))
    pull = np.bincount(col, (weight * (1 + degree))[row] / 4, len(names))
    if len(pairs):
        many = np.bincount(pair_row, minlength=len(pairs))
        pull += counterfactual * 2 * np.bincount(pair_col, many[pair_row], len(names)) / len(pairs)
    step = 1 / (pull + RIDGE + 1e-6)
    bias_step = 1 / (0.25 * float(weight @ (1 + degree)))
    w, bias = np.zeros(len(names)), float(np.log((weight @ label) / (1 - weight @ label)))
    ahead, bias_ahead, t = w, bias, 1.0
    for _ in range(steps):
        z = np.bincount(row, ahead[col], len(rows)) + bias_ahead
        error = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label)
        slope = np.bincount(col, error[row], len(names)) + RIDGE * ahead
        if len(pairs):
            change = np.bincount(pair_row, pair_sign * ahead[pair_col], len(pairs))
            slope += counterfactual * 2 * np.bincount(pair_col, pair_sign * change[pair_row], len(names)) / len(pairs)
        new = ahead - step * slope
        new = np.sign(new) * np.maximum(np.abs(new) - step * LASSO, 0)
        new_bias = bias_ahead - bias_step * error.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, bias_ahead = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    return Model({f: float(x) for f, x in zip(names, w) if x}, float(bias))


def sample(labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(doc_id, toxic, weight): at most ``MAX_ROWS`` labelled rows of each class that are not held out, with the rows that each stands for."""
    known = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    order = F.xxhash64("doc_id", F.lit(11))
    parts = [known.filter(F.col("toxic") == c).orderBy(order, "doc_id").limit(MAX_ROWS).withColumn("weight", F.lit(max(1.0, n / MAX_ROWS))) for c, n in sorted(counts.items())]
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else known.withColumn("weight", F.lit(1.0)).limit(0)


def train(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """A model from the labelled texts of ``df`` that are not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            own, others = [], []
            for t in part.column(2).to_pylist():
                words = words_of(t)
                own.append(list(features(words)))
                others.append([list(features(w)) for w in swapped(words)])
            cols = [pa.array(own, pa.list_(pa.int64())), pa.array(others, pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=["toxic", "weight", "features", "swapped"])

    chosen = stored(sample(labels, key, label), "toxicity-sample")
    texts = df.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("toxic", "weight", "text")  # the sample is bounded
    rows = stored(rows.mapInArrow(run, "toxic int, weight double, features array<long>, swapped array<array<long>>"), "toxicity-features")
    classes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(classes) < 2:
        return fit([(c, 1.0, [], []) for c in classes])
    n1, n0 = float(classes[1]), float(classes[0])
    counts = rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.count_if(F.col("toxic") == 1).alias("n1"), F.count_if(F.col("toxic") == 0).alias("n0"))
    share = (F.col("n1") + F.col("n0")) / (n1 + n0)
    z = (F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
    differ = counts.filter(F.col("n1") + F.col("n0") >= MIN_ROWS).filter(F.abs(z) >= MIN_Z).select("feature")
    keep = {r.feature for r in differ.collect()} | {f for w in SWAP for f in word_features(w)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, CUT_ROWS):
                part = batch.slice(i, CUT_ROWS)
                own = [sorted(keep.intersection(f)) for f in part.column(2).to_pylist()]
                others = [[sorted(keep.intersection(f)) for f in x] for x in part.column(3).to_pylist()]
                cols = [pa.array(own, pa.list_(pa.int64())), pa.array(others, pa.list_(pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=part.schema.names)

    small = rows.mapInArrow(cut, rows.schema).toArrow()
    return fit(sorted(zip(*(small.column(i).to_pylist() for i in range(4))), key=lambda r: (r[0], r[1], r[2], r[3])))


SCORED = "doc_id long, score double"


class _Weights(dict):
    """The features with a weight of each word; words that have none are kept as well."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        own = self[word] = tuple(f for f in word_features(word) if f in self.weights)
        return own


def score(df: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, score) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Weights(model.weights)
        for part in slices(batches):
            logits = []
            for t in part.column(1).to_pylist():
                found = set().union(*filter(None, map(own.__getitem__, words_of(t))))
                logits.append(model.bias + sum(model.weights[f] for f in sorted(found)))
            scores = 1 / (1 + np.exp(-np.clip(np.array(logits), -40, 40)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return df.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, SCORED)


def classify(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each text, by a model learnt from the rows that are not held out."""
    scored = score(df, train(df, labels, text, key, label), text, key)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
