"""Quality rules, line first: judge each line, drop failing lines, then reject documents that lost too much.

Whole texts are read in one narrow pass (no shuffle), so a hot source or a very long text costs only its own length.

Defined results: a null text is the empty text (no words, base failed, not kept); an empty table gives an empty
result; repeated rows are judged each on its own; extra columns pass through ``clean`` and never reach ``assess``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
#: Phrases of boilerplate lines, in lower case.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "cookie policy", "click here", "enable javascript", "licensed under",
    "lorem ipsum", "powered by", "privacy policy", "read more", "sign up", "subscribe to", "terms of service", "terms of use",
)
BOILERPLATE_LINE = re.compile("|".join(map(re.escape, BOILERPLATE)), re.I)
NAVIGATION_MARK = re.compile(r"[|»›•]")
#: Ends of a sentence, with what may close it.
SENTENCE_END = re.compile(r"""[.!?…:;。！？][\x22')\]»”’]*$""")

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: A document goes if failing lines held more than this share of its word characters.
MAX_LOST = 0.5

ASSESSED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_bad_lines long, lost_chars long"


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` (a power of two) words found at least twice in the text.

    Windows are compared exactly: ranks of windows of 1, 2, 4, 8 words come from pairs of ranks of half the length.
    """
    if len(words) <= window:
        return 0
    seen: dict[str, int] = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    half = 1
    while half < window:
        pair = rank[:-half] * (rank.max() + 1) + rank[half:]
        _, rank, counts = np.unique(pair, return_inverse=True, return_counts=True)
        if len(counts) == len(rank):  # every window of this length is found once
            return 0
        half *= 2
    starts = np.flatnonzero(counts[rank] > 1)
    if not len(starts):
        return 0
    return int(np.minimum(np.diff(starts, append=starts[-1] + window), window).sum())


def line_fails(line: str, words: list[str]) -> bool:
    """Whether a line with words fails one of the line rules."""
    chars = sum(map(len, words))
    if sum(map(line.count, SYMBOLS)) * 10 > chars:  # punctuation: symbols among the words
        return True
    loud = line.count("!!") + line.count("??")
    if loud * 4 >= len(words) + 3:  # punctuation: shouted marks behind every few words
        return True
    if len(NAVIGATION_MARK.findall(line)) >= 2 and len(words) <= 6 * (1 + len(NAVIGATION_MARK.findall(line))):  # navigation: a row of short entries
        return True
    if len(words) <= 12 and BOILERPLATE_LINE.search(line):  # boilerplate: a stock phrase is most of the line
        return True
    if len(words) >= 8 and 5 * sum(a == b for a, b in zip(words, words[1:])) > 2 * len(words):  # boilerplate: stuttered words
        return True
    return len(words) < 4 and not SENTENCE_END.search(line.rstrip())  # navigation: a lone label


def judge(text: str) -> tuple[tuple, list[str]]:
    """The measures of one text, in the order of ``ASSESSED`` without doc_id, and the lines that stay."""
    n_words = word_chars = dups = bad = lost = 0
    seen: set[str] = set()
    stay: list[str] = []
    every: list[str] = []
    for line in text.split("\n"):
        words = WORD.findall(line)
        if not words:
            stay.append(line)
            continue
        every += words
        chars = sum(map(len, words))
        word_chars += chars
        again = line in seen
        dups += again
        seen.add(line)
        if line_fails(line, words) or again:
            bad += 1
            lost += chars
        else:
            stay.append(line)
    n_words = len(every)
    repeats = repeated_words(every)
    failed = n_words < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n_words
    kept = not failed and lost <= MAX_LOST * word_chars
    return (n_words, word_chars, sum(map(text.count, SYMBOLS)), dups, repeats, failed, kept, bad, lost), stay


def _assess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2
    for part in slices(batches):
        rows = [judge(t)[0] for t in part.column(1).to_pylist()]
        cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=[c.split()[0] for c in ASSESSED.split(", ")])


def assess(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of measures and the verdict for each row of ``df``."""
    return df.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(_assess, ASSESSED)


def clean(df: DataFrame, text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """The kept rows of ``df`` with failing lines removed from their text; all columns stay, ``chars`` is counted anew."""
    names, types = df.columns, df.schema
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            judged = [judge(t or "") for t in part.column(at).to_pylist()]
            keep = pa.array([j[0][6] for j in judged], pa.bool_())
            texts = ["\n".join(j[1]) for j in judged]
            cols = [pa.array(texts, part.column(i).type) if i == at else part.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(keep)

    out = df.mapInArrow(run, types)
    return out.withColumn(chars, F.length(text).cast(types[chars].dataType)) if chars in names else out
