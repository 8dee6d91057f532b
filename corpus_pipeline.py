"""A corpus pipeline of five stages over ``documents``, each written as Parquet and read again before the next.

Quality rules, near-duplicates, secrets, mixing, tokens: a stage takes all that its predecessor kept, and all but the
last return the columns of ``documents``.

Defined results, of every stage: an empty table gives an empty one; columns beside those of ``documents`` stay, whatever
they are called, up to the tokens. A null or empty text holds no words and goes in the first stage. Rows that repeat an id
are rows of their own for the quality rules, secrets, mixing and tokens; of near-duplicates one row stays, also where its
id is null or stands on other texts as well. A null source is a source of its own, and an empty path for secrets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import bpe, mixing, quality, secrets, simhash
from brindle.llm.common import removed, scratch
from brindle.session import shared_path

#: No SQL: line rules, fingerprints and the forest have no form in it. tests/llm tests the stages against brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that fail."""
    return quality.clean(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more."""
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to tempered source weights, in a global random order."""
    own = "_" * (1 + max(map(len, docs.columns)))  # longer than any column's name
    return mixing.mix(docs, copy=f"{own}c", shuffle_key=f"{own}k").drop(f"{own}c", f"{own}k")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document; one row for each copy."""
    return bpe.encode(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("secret scan", redact_secrets),
    ("source mixing", mix_sources),
    ("token ids", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, in order. What a stage wrote for itself goes with its end, its table when the next one's stands."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if last:
            removed(spark, last)
        docs, last = spark.read.schema(out.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
