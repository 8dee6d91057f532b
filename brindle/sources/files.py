"""Source files as (path, content): folders, inline records, saved analyses, workspace selection, revisions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle import schemas
from brindle.functions import paths


def load_directory(spark: SparkSession, folder: str, pattern: str = "*.py") -> DataFrame:
    """Every file below ``folder`` that matches ``pattern``, with its path relative to it. Raises ValueError if there is none.

    Whole files are read by Spark, so that any store works; files that cannot be read or are no UTF-8 are skipped.
    """
    root = folder.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("ignoreCorruptFiles", True).load(root)
    raw = raw.filter(F.is_valid_utf8(F.col("content").cast("string")))
    full = F.col("path")
    inside = F.locate(f"{root.split('://')[-1]}/", full)
    files = raw.select(F.when(inside > 0, F.substring(full, inside + len(root.split("://")[-1]) + 1, F.length(full))).otherwise(full).alias("path"), F.col("content").cast("string").alias("content"))
    if files.isEmpty():
        raise ValueError(f"no {pattern} file below {folder}")
    return files


def from_records(spark: SparkSession, files: Iterable[dict]) -> DataFrame:
    """Files given inline as dictionaries of path and content."""
    return spark.createDataFrame([(f["path"], f["content"]) for f in files], schemas.FILES)


def read_analysis(spark: SparkSession, path: str) -> DataFrame:
    """A saved extraction, one JSON object a line, in the schema of ``extract``."""
    return spark.read.schema(schemas.EXTRACTED).json(path)


def write_analysis(extracted: DataFrame, path: str) -> None:
    extracted.write.mode("overwrite").json(path)


def select_workspace(files: DataFrame, include: tuple[str, ...] = ("**/*.py",), exclude_folders: tuple[str, ...] = paths.IGNORED_FOLDERS, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Files that match an include glob and neither stand in an excluded folder nor match an exclude glob."""
    path = F.col("path")
    kept = ~paths.in_folders(path, exclude_folders)
    if include:
        kept &= path.rlike("|".join(map(paths.glob_regex, include)))
    for glob in exclude:
        kept &= ~path.rlike(paths.glob_regex(glob))
    return files.filter(kept)


def files_at(snapshots: DataFrame, revision: str) -> DataFrame:
    """The files of one revision of (rev, path, content)."""
    return snapshots.filter(F.col("rev") == revision).select("path", "content")
