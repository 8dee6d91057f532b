"""Tables on disk that change together: fresh folders for what is written, and one pointer to all that is current.

There is no transactional table format here. A commit writes its rows through Spark's committer into fresh folders, and
only then creates one small file, the next manifest: for each table its schema and the folder of each of its parts, and
the number of the batch that wrote it. Readers see the tables before or after a commit, never a mixture; a commit that
fails before its manifest leaves nothing but folders that no manifest names. There is one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Manifests, and the folders that they alone name, that stay for readers who have them open.
KEPT = 2
WHOLE = "whole"


@dataclass(frozen=True)
class Staged:
    """Rows that lie in a fresh folder of a store, which no manifest names yet."""

    rows: DataFrame
    schema: StructType
    parts: dict[str, str]


class Store:
    """Named tables below one folder on any store that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _none(self, schema: StructType) -> DataFrame:
        return self.spark.createDataFrame(to_arrow_schema(schema).empty_table(), schema)  # lies in the plan, so that no Python worker starts for it

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _numbers(self) -> list[int]:
        fs, path = self._fs(f"{self.root}/_manifests")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()) if fs.exists(path) else []

    def _manifest(self, number: int | None = None) -> dict:
        if number is None:
            numbers = self._numbers()
            if not numbers:
                return {"batches": {}, "tables": {}}
            number = numbers[-1]
        fs, path = self._fs(f"{self.root}/_manifests/{number:012d}")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _point(self, manifest: dict) -> None:
        numbers = self._numbers()
        number = numbers[-1] + 1 if numbers else 0
        fs, path = self._fs(f"{self.root}/_manifests/{number:012d}")
        _, draft = self._fs(f"{self.root}/_manifests/.{uuid.uuid4().hex}")
        stream = fs.create(draft)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if not fs.rename(draft, path):  # whole or not at all
            raise RuntimeError(f"another writer made manifest {number}")
        stale = numbers[: -KEPT + 1] if KEPT > 1 else numbers
        named = {folder for n in [*numbers[len(stale) :], number] for t in self._manifest(n)["tables"].values() for folder in t["parts"].values()}
        for old in stale:
            for folder in {f for t in self._manifest(old)["tables"].values() for f in t["parts"].values()} - named:
                fs.delete(self._fs(f"{self.root}/{folder}")[1], True)
            fs.delete(self._fs(f"{self.root}/_manifests/{old:012d}")[1], False)

    def batch(self, source: str = "") -> int | None:
        """The number of the last batch of a source that was committed with one."""
        return self._manifest()["batches"].get(source)

    def tables(self) -> list[str]:
        return sorted(self._manifest()["tables"])

    def exists(self, name: str) -> bool:
        return name in self._manifest()["tables"]

    def parts(self, name: str) -> list[str]:
        """The parts of a table; none if there is no such table."""
        return sorted(self._manifest()["tables"].get(name, {"parts": {}})["parts"])

    def read(self, name: str, parts: list[str] | None = None) -> DataFrame:
        """A table, or those of its ``parts`` that there are."""
        table = self._manifest()["tables"].get(name)
        if table is None:
            raise FileNotFoundError(f"{self.root}/{name}")
        schema = StructType.fromJson(table["schema"])
        folders = [f for part, f in table["parts"].items() if parts is None or part in parts]
        reader = self.spark.read.schema(schema)
        return reader.parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self._none(schema)

    def stage(self, name: str, df: DataFrame, column: str | None, part: str = WHOLE, **options: int | str) -> Staged:
        """Writes rows of a table with parts, to be read before they are committed, and committed without being written again. Without a ``column`` all rows are of one ``part``, if there are any. ``options``: the writer's."""
        folder = f"{name}/v{uuid.uuid4().hex}"
        writer = df.write.options(compression="zstd", **options)
        if column is None:
            writer.parquet(f"{self.root}/{folder}")
            rows = self.spark.read.schema(df.schema).parquet(f"{self.root}/{folder}")
            return Staged(rows, df.schema, {} if rows.isEmpty() else {part: folder})
        writer.partitionBy(column).parquet(f"{self.root}/{folder}")
        fs, path = self._fs(f"{self.root}/{folder}")
        written = {n.split("=", 1)[1]: f"{folder}/{n}" for n in (s.getPath().getName() for s in fs.listStatus(path)) if n.startswith(f"{column}=")}
        schema = df.drop(column).schema
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in written.values()]) if written else self._none(schema)
        return Staged(rows, schema, written)

    def commit(self, whole: dict[str, DataFrame] | None = None, parts: dict[str, tuple[DataFrame | Staged, str, list[str]]] | None = None, batch: int | None = None, source: str = "") -> None:
        """Replaces tables in one step. ``whole``: by name, all rows. ``parts``: by name, rows, the column that holds their part, and the parts they replace.

        A frame may read the tables that it replaces. Of a table with parts, all others stay as they are and are not read.
        """
        manifest = self._manifest()
        tables = dict(manifest["tables"])
        for name, df in (whole or {}).items():
            folder = f"{name}/v{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{folder}")
            tables[name] = {"schema": df.schema.jsonValue(), "parts": {WHOLE: folder}}
        for name, (df, column, replaced) in (parts or {}).items():
            new = df if isinstance(df, Staged) else self.stage(name, df, column)
            kept = {p: f for p, f in tables.get(name, {"parts": {}})["parts"].items() if p not in replaced}
            tables[name] = {"schema": new.schema.jsonValue(), "parts": kept | new.parts}
        self._point({"batches": manifest["batches"] | ({} if batch is None else {source: batch}), "tables": tables})

    def write(self, name: str, df: DataFrame) -> None:
        """Replaces one table by ``df``, which may read the table itself."""
        self.commit({name: df})

    def append(self, name: str, df: DataFrame) -> None:
        """Adds rows to a table, as a part of their own."""
        self.commit(parts={name: (df.withColumn("__part", F.lit(uuid.uuid4().hex)), "__part", [])})

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> dict[str, int]:
        """Rows of ``rows`` replace those of the same keys. Returns how many were created and updated."""
        if not self.exists(name):
            self.write(name, rows)
            return {"created": self.read(name).count(), "updated": 0}
        old = self.read(name)
        updated = rows.join(old.select(*keys).distinct(), keys, "left_semi").count()
        total = rows.count()
        self.write(name, old.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True))
        return {"created": total - updated, "updated": updated}

    def reset(self, *names: str) -> dict[str, int]:
        """Removes tables; how many rows each held."""
        counts = {name: self.read(name).count() if self.exists(name) else 0 for name in names}
        manifest = self._manifest()
        self._point(manifest | {"tables": {n: t for n, t in manifest["tables"].items() if n not in names}})
        return counts


def save_patches(patches: DataFrame, path: str, key: str = "path", patch: str = "patch") -> None:
    """Patches as JSON lines of their key and text, so that line ends survive."""
    patches.select(F.col(key).alias("path"), F.col(patch).alias("patch")).write.mode("overwrite").json(path)


def load_patches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, patch string").json(path)


def write_vectors(store: Store, vectors: DataFrame) -> None:
    """Replaces the vector table, so that no row of an older, longer index stays behind."""
    store.write("vectors", vectors)
