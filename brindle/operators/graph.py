"""The property graph as two tables: building, counting, neighbourhoods, invalidation, upserts, integrity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions import paths

SYMBOLS = ("Function", "Class")


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame


def node_id(label: Column | str, *parts: Column) -> Column:
    """A stable id from the label and what identifies a node."""
    label = F.lit(label) if isinstance(label, str) else label
    return F.sha2(F.concat_ws("\x1f", label, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def _edges(df: DataFrame, src: Column, dst: Column, kind: str) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type")).distinct()


def symbol_id(label: str, identity: str) -> Column:
    """``path``: one node for each file and name and place. ``content``: equal definitions at equal lines of different files are one node."""
    signature = [F.col("signature")] if label == "Function" else []
    common = [F.col("name"), F.col("start_line"), F.col("end_line"), F.col("content"), *signature]
    return node_id(label, F.col("path"), F.col("name"), F.col("start_line")) if identity == "path" else node_id(label, *common)


def build(extracted: DataFrame, repository: str = "repository", identity: str = "path", resolve: str = "name") -> Graph:
    """Nodes and edges of extracted files: Repository, File, Module, Class, Function; CONTAINS, DEFINES, IMPORTS, INHERITS, CALLS.

    Functions are the top-level ones. ``resolve="name"`` links a call to every function of that name; ``"same_file_first"``
    to those of the caller's file if it has any. Names are joined, so that nothing depends on the order of files.
    The extraction is read once for each kind of node: pass a stored or cached table, or files are parsed so often.
    """
    functions = extracted.select("path", F.inline("functions")).filter("class_name is null and not is_nested").withColumn("id", symbol_id("Function", identity))
    classes = extracted.select("path", F.inline("classes")).withColumn("id", symbol_id("Class", identity))
    files = extracted.select("path", node_id("File", F.col("path")).alias("id"))
    imports = extracted.select("path", F.inline("imports")).filter("module is not null")
    root = node_id("Repository", F.lit(repository))
    none = lambda *names: [F.lit(None).cast("int" if n.endswith("line") else "string").alias(n) for n in names]
    nodes = extracted.sparkSession.range(1).select(root.alias("id"), F.lit("Repository").alias("label"), F.lit(repository).alias("name"), *none("path", "start_line", "end_line", "signature", "content"))
    nodes = nodes.unionByName(files.select("id", F.lit("File").alias("label"), F.col("path").alias("name"), "path", *none("start_line", "end_line", "signature", "content")))
    nodes = nodes.unionByName(imports.select(node_id("Module", F.col("module")).alias("id"), F.lit("Module").alias("label"), F.col("module").alias("name"), *none("path", "start_line", "end_line", "signature", "content")))
    nodes = nodes.unionByName(functions.select("id", F.lit("Function").alias("label"), "name", "path", "start_line", "end_line", "signature", "content"))
    nodes = nodes.unionByName(classes.select("id", F.lit("Class").alias("label"), "name", "path", "start_line", "end_line", F.lit(None).cast("string").alias("signature"), "content"))
    nodes = nodes.groupBy("id").agg(*[F.first(c).alias(c) if c != "path" else F.min(c).alias(c) for c in nodes.columns if c != "id"]).withColumn("updated_at", F.current_timestamp())
    file = node_id("File", F.col("path"))
    edges = _edges(files, root, F.col("id"), "CONTAINS")
    edges = edges.unionByName(_edges(functions, file, F.col("id"), "DEFINES")).unionByName(_edges(classes, file, F.col("id"), "DEFINES"))
    edges = edges.unionByName(_edges(imports, file, node_id("Module", F.col("module")), "IMPORTS"))
    bases = classes.select("id", F.explode("bases").alias("base")).join(classes.select(F.col("name").alias("base"), F.col("id").alias("to")), "base")
    edges = edges.unionByName(_edges(bases, F.col("id"), F.col("to"), "INHERITS"))
    # a call links every function of the caller's name and every function of the callee's: names are global
    calls = functions.select(F.col("name").alias("caller"), F.col("path").alias("from_path"), F.explode("calls.name").alias("callee")).distinct()
    edges = edges.unionByName(resolve_calls(calls, functions.select("id", "name", "path"), resolve))
    return Graph(nodes, edges.withColumn("count", F.lit(None).cast("long")).withColumn("updated_at", F.current_timestamp()))


def resolve_calls(calls: DataFrame, functions: DataFrame, resolve: str = "name") -> DataFrame:
    """(src, dst, CALLS) of calls (caller, from_path, callee) by name among functions (id, name, path)."""
    to = functions.select(F.col("id").alias("dst"), F.col("name").alias("callee"), F.col("path").alias("to_path"))
    if resolve == "name":
        by = functions.select(F.col("id").alias("src"), F.col("name").alias("caller"))
        found = calls.select("caller", "callee").distinct().join(by, "caller").join(to, "callee")
    else:
        by = functions.select(F.col("id").alias("src"), F.col("name").alias("caller"), F.col("path").alias("from_path"))
        found = calls.join(by, ["caller", "from_path"]).join(to, "callee")
        own = F.max(F.col("to_path") == F.col("from_path")).over(W.partitionBy("src", "callee"))
        found = found.withColumn("own", own).filter(~F.col("own") | (F.col("to_path") == F.col("from_path")))
    return _edges(found, F.col("src"), F.col("dst"), "CALLS")


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def edge_totals(edges: DataFrame, kind: str = "DYNAMICALLY_CALLS") -> DataFrame:
    """(edges, total): how many edges of a type there are, and the sum of their counts."""
    return edges.filter(F.col("type") == kind).agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum("count"), F.lit(0)).alias("total"))


def top_degree(edges: DataFrame, side: str = "src", k: int = 10) -> DataFrame:
    """The ``k`` nodes with the most edges on one side."""
    return edges.groupBy(F.col(side).alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(k)


def neighbours(edges: DataFrame, ids: DataFrame, kind: str = "CALLS") -> DataFrame:
    """(id, neighbour, direction): callers and callees of ``ids(id)``, one row for each neighbour; a caller wins over a callee.

    An edge is a row for each of its ends, dealt by both, so that callers times callees never appear, and edges that repeat
    count once. Rows are counted where they were dealt, not before: that would hold a task's edges, which hardly repeat.
    """
    end = lambda a, b, caller: F.struct(F.col(a).alias("id"), F.col(b).alias("neighbour"), F.lit(caller).alias("caller"))
    ends = edges.filter(F.col("type") == kind).select(F.inline(F.array(end("dst", "src", True), end("src", "dst", False))))
    near = ends.repartition("id", "neighbour").groupBy("id", "neighbour").agg(F.max("caller").alias("caller"))
    return near.join(ids.select("id"), "id", "left_semi").select("id", "neighbour", F.when(F.col("caller"), "caller").otherwise("callee").alias("direction"))


def expand(graph: Graph, names: DataFrame) -> DataFrame:
    """(name, code, path, neighbours array<struct<name, direction, path>>): the symbols of ``names(name)`` with their callers and callees by name."""
    symbols = graph.nodes.filter(F.col("label").isin(*SYMBOLS))
    wanted = symbols.join(names.select("name").distinct(), "name")
    near = neighbours(graph.edges, wanted.select("id"))
    known = symbols.select(F.col("id").alias("neighbour"), F.col("name").alias("other"), F.col("path").alias("other_path"))
    near = near.join(known, "neighbour").join(wanted.select("id", "name"), "id")
    once = near.groupBy("name", "other").agg(F.max(F.struct("direction", "other_path")).alias("best"))
    listed = once.groupBy("name").agg(F.sort_array(F.collect_list(F.struct(F.col("other").alias("name"), F.col("best.direction").alias("direction"), F.col("best.other_path").alias("path")))).alias("neighbours"))
    first = wanted.groupBy("name").agg(F.min_by(F.struct("content", "path"), F.struct("path", "start_line")).alias("at"))
    empty = F.array().cast("array<struct<name:string,direction:string,path:string>>")
    return first.join(listed, "name", "left").select("name", F.col("at.content").alias("code"), F.col("at.path").alias("path"), F.coalesce("neighbours", empty).alias("neighbours"))


def accumulate(edges: DataFrame, counts: DataFrame) -> DataFrame:
    """(src, dst, type, count, state): edges with new counts (src, dst, type, n) added; state is created, updated or kept."""
    both = edges.select("src", "dst", "type", "count", F.lit(True).alias("had")).join(counts.groupBy("src", "dst", "type").agg(F.sum("n").alias("n")), ["src", "dst", "type"], "full_outer")
    state = F.when(F.col("had").isNull(), "created").when(F.col("n").isNotNull(), "updated").otherwise("kept")
    return both.select("src", "dst", "type", (F.coalesce("count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("count"), state.alias("state"))


def drop_nodes(graph: Graph, ids: DataFrame) -> Graph:
    """The graph without the nodes of ``ids(id)`` and without their edges."""
    gone = ids.select("id").distinct()
    edges = graph.edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return Graph(graph.nodes.join(gone, "id", "left_anti"), edges.select(*graph.edges.columns))


def symbols_of(graph: Graph, changed: DataFrame) -> DataFrame:
    """(id): functions and classes of files ``changed(path)``, or of symbols ``changed(path, name)`` or ``changed(path, name, label)``."""
    on = [c for c in ("path", "name", "label") if c in changed.columns]
    return graph.nodes.filter(F.col("label").isin(*SYMBOLS)).join(changed.select(*on).distinct(), on, "left_semi").select("id")


def invalidate(graph: Graph, changed: DataFrame) -> Graph:
    """The graph without the symbols of ``changed`` and their edges; file nodes stay."""
    return drop_nodes(graph, symbols_of(graph, changed))


def impact(graph: Graph, ids: DataFrame) -> DataFrame:
    """(relationships, neighbours, types, labels): what removing ``ids(id)`` would touch."""
    gone = ids.select("id").distinct()
    out = graph.edges.join(gone.withColumnRenamed("id", "src"), "src").select("src", "dst", "type", F.col("dst").alias("other"))
    into = graph.edges.join(gone.withColumnRenamed("id", "dst"), "dst").select("src", "dst", "type", F.col("src").alias("other"))
    both = out.unionByName(into).distinct().join(graph.nodes.select(F.col("id").alias("other"), "label"), "other", "left")
    return both.agg(F.countDistinct("src", "dst", "type").alias("relationships"), F.countDistinct("other").alias("neighbours"), F.sort_array(F.collect_set("type")).alias("types"), F.sort_array(F.collect_set("label")).alias("labels"))


def removal_counts(graph: Graph, ids: DataFrame) -> DataFrame:
    """(nodes, relationships) that dropping ``ids(id)`` removes."""
    nodes = graph.nodes.join(ids.select("id").distinct(), "id", "left_semi").agg(F.count(F.lit(1)).alias("nodes"))
    return nodes.join(F.broadcast(impact(graph, ids).select("relationships")))


def modify(graph: Graph, changes: DataFrame) -> Graph:
    """Symbols of ``changes(path, name[, label][, signature][, docstring][, invalidated][, modified_at])`` changed in place.

    A null signature or docstring keeps the old one; ``invalidated`` is true and ``modified_at`` now unless they are given.
    Of several changes of one symbol the last by ``modified_at`` counts. Nodes get the columns that they lack.
    """
    on = [c for c in ("path", "name", "label") if c in changes.columns]
    given = lambda c, other: F.col(c) if c in changes.columns else other
    none = F.lit(None).cast("string")
    new = changes.select(*[F.col(c).alias(f"__{c}") for c in on], F.struct(
        F.coalesce(given("modified_at", F.lit(None)).cast("timestamp"), F.current_timestamp()).alias("modified_at"), given("signature", none).cast("string").alias("signature"),
        given("docstring", none).cast("string").alias("docstring"), F.coalesce(given("invalidated", F.lit(True)).cast("boolean"), F.lit(True)).alias("invalidated"),
    ).alias("__new"))
    new = new.groupBy(*[f"__{c}" for c in on]).agg(F.max_by("__new", "__new").alias("__new"))
    kinds = {"docstring": "string", "invalidated": "boolean", "modified_at": "timestamp", "signature": "string"}
    nodes = graph.nodes.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in graph.nodes.columns})
    hit = [F.col(c) == F.col(f"__{c}") for c in on]
    joined = nodes.join(new, [*hit, F.col("label").isin(*SYMBOLS)], "left")
    touched = F.col("__new").isNotNull()
    values = {c: F.coalesce(F.col(f"__new.{c}"), F.col(c)) for c in kinds}
    if "updated_at" in nodes.columns:
        values["updated_at"] = F.when(touched, F.col("__new.modified_at")).otherwise(F.col("updated_at"))
    return Graph(joined.withColumns(values).select(*nodes.columns), graph.edges)


def update_files(files: DataFrame, old: DataFrame, repository: str = "repository", **how) -> tuple[DataFrame, Graph]:
    """The extracted files after ``files`` replaced those of the same paths in ``old``, and their graph.

    Name resolution is global: a new definition in one file can add edges between others. Calls are therefore resolved over
    the extraction table again, which costs two joins on names; parsing, the dear part, is done for changed files only.
    """
    merged = old.join(files.select("path").distinct(), "path", "left_anti").unionByName(files)
    return merged, build(merged, repository, **how)


def orphans(graph: Graph) -> DataFrame:
    """Nodes without any edge, but for repositories."""
    ends = graph.edges.select(F.col("src").alias("id")).union(graph.edges.select("dst")).distinct()
    return graph.nodes.filter(F.col("label") != "Repository").join(ends, "id", "left_anti")


def dangling(graph: Graph) -> DataFrame:
    """Edges with an end that is no node."""
    ids = graph.nodes.select("id")
    no_src = graph.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").select("src", "dst", "type")
    no_dst = graph.edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "type")
    return no_src.unionByName(no_dst).distinct()


def integrity(graph: Graph) -> DataFrame:
    """One row: nodes, edges, orphans, dangling edges, and whether the graph is sound."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    row = count(graph.nodes, "nodes").join(count(graph.edges, "edges")).join(count(orphans(graph), "orphans")).join(count(dangling(graph), "dangling"))
    return row.withColumn("sound", (F.col("orphans") == 0) & (F.col("dangling") == 0))


def recently_updated(nodes: DataFrame, now: Column, hours: int = 1) -> DataFrame:
    return nodes.filter(F.col("updated_at") > now - F.expr(f"INTERVAL {hours} HOURS"))


def test_nodes(files: DataFrame) -> DataFrame:
    """(id, label, name, path) of a Test node for each test file."""
    tests = files.select("path").distinct().filter(paths.is_test(F.col("path")))
    return tests.select(node_id("Test", F.col("path")).alias("id"), F.lit("Test").alias("label"), paths.stem(F.col("path")).alias("name"), "path")
