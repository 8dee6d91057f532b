"""Structure, text, patterns, diffs and the maintenance loop, over generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text
from brindle.functions.structure import extract
from brindle.functions.vectors import cosine, hashed_embedding
from brindle.operators import context, coverage, graph, patterns, search, symbols, vector_index
from brindle.plans import drift, retrieval
from brindle.queries.base import once, query, spread, stored, table
from brindle.queries.core import _COS, _GRAPH, _HYBRID, QUESTION, _code, _graph, document_index, extracted
from brindle.session import shared_path
from brindle.sources import changes, files, hunks
from brindle.sources.sinks import Store
from brindle.streaming import loop


def said(*parts: str | Column) -> Column:
    """Texts and columns as one text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def pick(key: Column, *choices: Column | str) -> Column:
    """The choice whose place is ``key`` modulo their number."""
    return F.element_at(F.array(*[F.lit(c) if isinstance(c, str) else c for c in choices]), (key % len(choices) + 1).cast("int"))


# --- structure ------------------------------------------------------------------------------------------------------------


@query("""SELECT 'src/p' || p_partkey || '.py' AS path, 'C' || p_partkey AS name, 'class' AS symbol_type, 4 AS start_line, 5 AS end_line, 'class C' || p_partkey || CASE WHEN p_partkey > 0 THEN '(C' || (p_partkey - 1) || ')' ELSE '(Unknown)' END AS signature FROM part
UNION ALL SELECT 'src/p' || p_partkey || '.py', 'f' || p_partkey, 'function', 8, 11, 'def f' || p_partkey || '(a, b)' FROM part""")
def snapshot_symbols(spark, d):
    """EXT6: the symbols of generated files that snapshots are compared by."""
    return symbols.snapshot(extracted(spark, d)).drop("docstring")


@query("""SELECT 'C' || p_partkey AS name, 'class' AS symbol_type, 2 AS lines_of_code, 'C' || CASE WHEN p_partkey > 0 THEN CAST(p_partkey - 1 AS VARCHAR) ELSE ' - 1' END AS bases FROM part UNION ALL SELECT 'f' || p_partkey, 'function', 4, '' FROM part""")
def symbol_sizes(spark, d):
    """EXT9: lines of code of each symbol, in the deep analysis of symbols that are asked for."""
    rows = extracted(spark, d)
    wanted = rows.select("path", F.explode("symbols.name").alias("symbol_name"))
    return symbols.symbol(rows, wanted).select(F.col("symbol_name").alias("name"), "symbol_type", "lines_of_code", F.array_join("base_classes", ",").alias("bases"))


@query("""SELECT 'src/p' || p_partkey || '.py' AS path, 'C' || p_partkey AS name, 'class' AS type, 4 AS start_line, 7 AS end_line FROM part UNION ALL SELECT 'src/p' || p_partkey || '.py', 'f' || p_partkey, 'function', 8, 12 FROM part""")
def indent_symbols(spark, d):
    """EXT11: symbols by indentation, each up to the next line that is indented no deeper."""
    return text.indent_symbols(_code(spark, d))


_TESTS = "SELECT 'tests/test_p' || p_partkey || '.py' AS test, unnest(['pkg' || p_partkey % 7, 'other' || p_partkey % 3]) AS module FROM part"


@query(_TESTS)
def test_imports(spark, d):
    """EXT12: the first segments of the modules that generated test files import."""
    key = F.col("p_partkey")
    code = said("from pkg", key % 7, ".sub import x\nimport other", key % 3, ".y\n")
    rows = spread(table(spark, d, "part")).select(said("tests/test_p", key, ".py").alias("path"), code.alias("content"))
    return coverage.test_imports(extract(rows))


@query("""SELECT (SELECT count(*) FROM orders) AS tests, (SELECT count(*) FROM customer) AS sources, (SELECT count(DISTINCT o_custkey) FROM orders) AS covered, (SELECT count(*) FROM customer) - (SELECT count(DISTINCT o_custkey) FROM orders) AS uncovered,
round((SELECT count(DISTINCT o_custkey) FROM orders) / (SELECT count(*) FROM customer) * 100, 2) AS percent""")
def mapping_report(spark, d):
    """AGG17: how many sources tests import, where orders are tests of their customers."""
    orders = table(spark, d, "orders").select(said("tests/test_", F.col("o_orderkey"), ".py").alias("test"), said("c", F.col("o_custkey")).alias("module"))
    every = table(spark, d, "customer").select(said("src/c", F.col("c_custkey"), ".py").alias("path")).union(orders.select("test"))
    return coverage.mapping_report(every, coverage.tested_sources(every, orders))


@query("SELECT 'f' || p_partkey AS name, 'Function' AS type, 8 AS start_line, 64 AS size FROM part UNION ALL SELECT 'C' || p_partkey, 'Class', 4, 64 FROM part")
def symbol_projection(spark, d):
    """PRJ1, SNK3: the vectors of symbols, written as the vector table and read again."""
    store = Store(spark, shared_path(spark, "vectors"))
    store.write("vectors", retrieval.symbol_vectors(graph.build(extracted(spark, d))))
    return store.read("vectors").select("name", "type", "start_line", F.size("embedding").alias("size"))


@query("""SELECT 'f' || p_partkey AS name, 'f' || p_partkey || ' def f' || p_partkey || '(a, b=1):' || chr(10) || '    if a and b:' || chr(10) || '        return f' || (p_partkey + 1) || '(a)' || chr(10) || '    return b' AS text FROM part
UNION ALL SELECT 'C' || p_partkey, 'C' || p_partkey || ' class C' || p_partkey || '(C' || (p_partkey - 1) || '):' || chr(10) || '    pass' FROM part""")
def symbol_documents(spark, d):
    """PRJ2, SET1: functions and classes as the different texts of the keyword index."""
    return retrieval.symbol_documents(graph.build(extracted(spark, d))).select("name", "text")


@query("""WITH p AS (SELECT p_partkey AS key, p_partkey % 5 AS n FROM part) SELECT key, CAST(n > 0 AS BIGINT) AS buckets, CAST(n AS DOUBLE) AS weight, n > 0 AS same_as_said, CASE WHEN n > 0 THEN 1 ELSE 0 END::DOUBLE AS cosine_once, true AS sums, CAST(64 AS BIGINT) AS size FROM p""")
def hashed_vectors(spark, d):
    """TXT3: a word said none to four times is one bucket of that weight; more words do not turn a vector, other words do, and a vector of two texts is the sum of theirs."""
    key, word, other = F.col("p_partkey"), F.array(said("w", F.col("p_partkey"))), F.array(F.col("p_name"), F.col("p_brand"))
    times = F.array_repeat(word[0], (key % 5).cast("int"))
    vectors = spread(table(spark, d, "part")).select(key.alias("key"), *[hashed_embedding(w).alias(n) for n, w in (("v", times), ("once", word), ("other", other), ("both", F.concat(times, other)))])
    sums = F.zip_with("v", "other", lambda a, b: a + b) == F.col("both")
    weight = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x))
    # the bucket that is filled is the one of the word
    same = F.exists(F.zip_with("v", "once", lambda a, b: (a != 0) & (b != 0)), lambda x: x)
    return vectors.select("key", F.size(F.filter("v", lambda x: x != 0)).cast("long").alias("buckets"), weight.alias("weight"), same.alias("same_as_said"), F.round(cosine(F.col("v"), F.col("once")), 6).alias("cosine_once"), sums.alias("sums"), F.size("v").cast("long").alias("size"))


# --- code of many shapes: each customer a file ------------------------------------------------------------------------------


def _varied(spark: SparkSession, d: str) -> DataFrame:
    """Files of four shapes: an async function with all kinds of parameters, a decorator and a nested one; a class with methods; relative and nested imports; one that does not parse."""
    k = F.col("c_custkey")
    loops = F.array_join(F.array_repeat(F.lit("    while b:\n        b = 0\n"), (k % 3).cast("int")), "")
    first = said(
        "from ..pkg", k % 7, " import thing as t", k, ", other\n\n@route('/", k, "')\nasync def load", k, "(a, /, b: int, *args, c=", k % 5, ", **kw) -> dict:\n    \"\"\"Loads.\"\"\"\n    def inner(x):\n        return t", k,
        ".run(x).close(x)\n    for i in args:\n        if i and b or c:\n            inner(i)\n", loops, "    return {}\n",
    )
    second = said(
        "import os.path as p", k, ", sys\n\nclass Box", k, "(base.Box, Generic[T]):\n    size = make(1)\n    @staticmethod\n    def open(path=None):\n        try:\n            return p", k,
        ".exists(path)\n        except (OSError, ValueError):\n            return None\n    async def close(self) -> None:\n        await self.pool.end", k, "(", k, ", 'x')\n",
    )
    third = said("from . import x", k, "\ndef f", k, "(*, key, other=", k, "):\n    from ...deep.er import *\n    return [y for y in x", k, ".all() if y and key]\n")
    return spread(table(spark, d, "customer")).select(said("v/c", k, ".py").alias("path"), pick(k, first, second, third, said("def broken", k, "(:\n")).alias("content"))


def _varied_extracted(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, "varied", d, lambda: stored(extract(_varied(spark, d)), "varied"))


_VARIED = "c AS (SELECT c_custkey AS k, c_custkey % 4 AS kind, c_custkey % 3 AS loops, 'v/c' || c_custkey || '.py' AS path FROM customer)"


@query(f"""WITH {_VARIED} SELECT path, 'load' || k AS name, 4 AS start_line, 11 + 2 * loops AS end_line, true AS is_async, false AS is_nested, CAST(NULL AS VARCHAR) AS class_name,
'a:positional_only,b:positional_or_keyword:int,args:var_positional,c:keyword_only=' || k % 5 || ',kw:var_keyword' AS parameters, 'dict' AS returns, 'def load' || k || '(b, *args, c, **kw)' AS signature, 'Loads.' AS docstring, 'inner,route' AS calls FROM c WHERE kind = 0
UNION ALL SELECT path, 'inner', 6, 7, false, true, NULL, 'x:positional_or_keyword', NULL, 'def inner(x)', NULL, 't' || k || '.run' FROM c WHERE kind = 0
UNION ALL SELECT path, 'open', 6, 10, false, false, 'Box' || k, 'path:positional_or_keyword=None', NULL, 'def open(path)', NULL, 'p' || k || '.exists' FROM c WHERE kind = 1
UNION ALL SELECT path, 'close', 11, 12, true, false, 'Box' || k, 'self:positional_or_keyword', 'None', 'def close(self)', NULL, 'self.pool.end' || k FROM c WHERE kind = 1
UNION ALL SELECT path, 'f' || k, 2, 4, false, false, NULL, 'key:keyword_only,other:keyword_only=' || k, NULL, 'def f' || k || '(key, other)', NULL, 'x' || k || '.all' FROM c WHERE kind = 2""")
def varied_functions(spark, d):
    """EXT1, EXT2, EXT5: functions of every shape: async, nested, methods, kinds of parameters with defaults and annotations, calls of the innermost function."""
    f = _varied_extracted(spark, d).select("path", F.inline("functions"))
    shown = F.transform("parameters", lambda p: F.concat(p["name"], F.lit(":"), p["kind"], F.coalesce(F.concat(F.lit(":"), p["annotation"]), F.lit("")), F.coalesce(F.concat(F.lit("="), p["default"]), F.lit(""))))
    calls = F.array_join(F.array_sort(F.transform("calls", lambda c: c["name"])), ",")
    return f.select("path", "name", "start_line", "end_line", "is_async", "is_nested", "class_name", F.array_join(shown, ",").alias("parameters"), F.col("return_annotation").alias("returns"), "signature", "docstring", calls.alias("calls"))


@query(f"""WITH {_VARIED} SELECT path, 'from_import' AS type, 1 AS lineno, 'pkg' || k % 7 AS module, 'thing' AS name, 't' || k AS alias, 2 AS level FROM c WHERE kind = 0
UNION ALL SELECT path, 'from_import', 1, 'pkg' || k % 7, 'other', NULL, 2 FROM c WHERE kind = 0
UNION ALL SELECT path, 'import', 1, 'os.path', NULL, 'p' || k, 0 FROM c WHERE kind = 1
UNION ALL SELECT path, 'import', 1, 'sys', NULL, NULL, 0 FROM c WHERE kind = 1
UNION ALL SELECT path, 'from_import', 1, NULL, 'x' || k, NULL, 1 FROM c WHERE kind = 2
UNION ALL SELECT path, 'from_import', 3, 'deep.er', '*', NULL, 3 FROM c WHERE kind = 2""")
def varied_imports(spark, d):
    """EXT4: imports with levels and aliases, nested ones as well."""
    return _varied_extracted(spark, d).select("path", F.inline("imports")).select("path", "type", "lineno", "module", "name", "alias", "level")


@query(f"""WITH {_VARIED} SELECT path, 'load' || k AS name, 'function' AS type, 'route(''/' || k || ''')' AS decorators, 'b:int,*args,c=' || k % 5 || ',**kw' AS parameters, 'dict' AS returns, '' AS bases, '' AS methods,
'close(x) of t' || k || '.run(x);inner(i);route(''/' || k || ''');run(x) of t' || k AS calls, 5 + loops AS complexity, 8 + 2 * loops AS lines, 2 AS imports FROM c WHERE kind = 0
UNION ALL SELECT path, 'inner', 'function', '', 'x', NULL, '', '', 'close(x) of t' || k || '.run(x);run(x) of t' || k, 1, 2, 2 FROM c WHERE kind = 0
UNION ALL SELECT path, 'Box' || k, 'class', '', '', NULL, 'base.Box,Generic[T]', 'open,close', 'end' || k || '(' || k || ', ''x'') of self.pool;exists(path) of p' || k || ';make(1)', 2, 10, 2 FROM c WHERE kind = 1
UNION ALL SELECT path, 'open', 'function', 'staticmethod', 'path=None', NULL, '', '', 'exists(path) of p' || k, 2, 5, 2 FROM c WHERE kind = 1
UNION ALL SELECT path, 'close', 'function', '', 'self', 'None', '', '', 'end' || k || '(' || k || ', ''x'') of self.pool', 1, 2, 2 FROM c WHERE kind = 1
UNION ALL SELECT path, 'f' || k, 'function', '', 'key,other=' || k, NULL, '', '', 'all() of x' || k, 2, 3, 1 FROM c WHERE kind = 2""")
def varied_symbols(spark, d):
    """EXT6, EXT7, EXT8: symbols in depth: decorators, parameters, return types, bases, methods, calls with arguments, complexity, lines and imports of the module."""
    s = _varied_extracted(spark, d).select("path", F.inline("deep"))
    shown = F.transform("parameters", lambda p: F.concat(p["name"], F.coalesce(F.concat(F.lit(":"), p["annotation"]), F.lit("")), F.coalesce(F.concat(F.lit("="), p["default_value"]), F.lit(""))))
    call = F.transform("functions_called", lambda c: F.concat(c["function_name"], F.lit("("), F.array_join(c["arguments"], ", "), F.lit(")"), F.when(c["is_method_call"], F.concat(F.lit(" of "), c["object_name"])).otherwise("")))
    return s.select(
        "path", F.col("symbol_name").alias("name"), F.col("symbol_type").alias("type"), F.array_join("decorators", ",").alias("decorators"), F.array_join(shown, ",").alias("parameters"), F.col("return_type").alias("returns"),
        F.array_join("base_classes", ",").alias("bases"), F.array_join("methods", ",").alias("methods"), F.array_join(F.array_sort(call), ";").alias("calls"), F.col("cyclomatic_complexity").alias("complexity"), F.col("lines_of_code").alias("lines"), F.size("imports_used").alias("imports"),
    )


@query("SELECT doc_id, md5(left(text, 1200)) AS content, md5(left(text, 100)) AS docstring FROM documents")
def previews(spark, d):
    """PRJ3: texts cut for reports."""
    body = F.col("text")
    return spread(table(spark, d, "documents")).select("doc_id", F.md5(text.preview(body, 1200)).alias("content"), F.md5(text.preview(body, 100)).alias("docstring"))


# --- answers, explanations, prompts -----------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'def f' || o_orderkey || '():' || chr(10) || '    pass' WHEN 1 THEN 'x = ' || o_orderkey WHEN 2 THEN 'import m' || o_orderkey || chr(10) || 'x = 1' ELSE 'a = ' || o_orderkey || chr(10) || 'b = 2' END AS code FROM orders""")
def response_code(spark, d):
    """EXT13: the code in answers of four shapes."""
    key = F.col("o_orderkey")
    answer = pick(key, said("Sure:\n```python\ndef f", key, "():\n    pass\n```\nDone ", key), said(" x = ", key, "\n"), said("Here:\n\nimport m", key, "\nx = 1"), said("```\na = ", key, "\n```\nand\n```\nb = 2\n```"))
    return table(spark, d, "orders").select("o_orderkey", text.code_of_response(answer).alias("code"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'has the shape of similar code' WHEN 1 THEN 'answers the finding helper-call-drift; handles errors; calls validate_' || o_orderkey % 5
WHEN 2 THEN 'follows the convention one exit; returns in 1 places instead of 2' ELSE 'handles errors no more' END AS said, CASE o_orderkey % 4 WHEN 1 THEN 'validate_' || o_orderkey % 5 ELSE '' END AS new_calls FROM orders""")
def explanations(spark, d):
    """TXT13, SET4: what suggestions of four kinds changed, and their new calls."""
    key = F.col("o_orderkey")
    old = pick(key, "x", "return x", "return 1\nreturn 2", "try:\n  pass")
    new = pick(key, said("x"), said("try:\n    return validate_", key % 5, "(x)"), said("return 1"), said("pass"))
    rows = table(spark, d, "orders").select("o_orderkey", old.alias("a"), new.alias("b"), pick(key, "", "helper-call-drift", "", "").alias("p"), pick(key, "", "", "one exit", "").alias("c"))
    return rows.select("o_orderkey", text.explanation(F.col("a"), F.col("b"), F.col("p"), F.col("c")).alias("said"), F.array_join(text.new_calls(F.col("a"), F.col("b")), ",").alias("new_calls"))


@query("""SELECT s_suppkey, '# Request' || chr(10) || 'add ' || s_name || chr(10) || chr(10) || '# Relevant symbols' || chr(10) || chr(10) || '1. ' || s_name || ' (relevance: ' || CASE WHEN s_suppkey % 10 >= 8 THEN 'High' WHEN s_suppkey % 10 >= 5 THEN 'Medium' ELSE 'Low' END
|| ', score: 0.' || s_suppkey % 10 || '000)' || chr(10) || '   doc' || chr(10) || chr(10) || '# Code of the repository' || chr(10) || chr(10) || '### ' || s_name || ' in s.py' || chr(10) || 'pass' || chr(10) || 'Related: a, b' || chr(10) || chr(10) || 'Answer with code in the style of the code above.' AS prompt FROM supplier""")
def prompts(spark, d):
    """TXT11, TXT12: a prompt for each supplier."""
    name = F.col("s_name")
    results = F.array(F.struct(name.alias("name"), ((F.col("s_suppkey") % 10) / 10).alias("score"), F.lit("doc").alias("docstring")))
    context = F.array(F.struct(name.alias("name"), F.lit("s.py").alias("path"), F.lit("pass").alias("code"), F.array(F.lit("a"), F.lit("b")).alias("neighbours")))
    return table(spark, d, "supplier").select("s_suppkey", text.prompt(said("add ", name), results, context).alias("prompt"))


# --- patterns: a file for each part, with four symbols alike and a new one of six kinds ----------------------------------------

_ALIKE = "def {}(a, b):\n    try:\n        return {{}}\n    except E:\n        log(a)\n        check(b)\n        raise\n"
_KINDS = (
    _ALIKE.format("new"),
    "def new(a, b):\n    try:\n        return 1\n    except E:\n        log(a)\n        check(b)\n        raise\n",
    "def new(a, b):\n    log(a)\n    check(b)\n    return {}\n",
    "def new(a, b):\n    try:\n        return {}\n    except E:\n        raise\n",
    "def new(a, b, c, d):\n    try:\n        return {}\n    except E:\n        log(a)\n        check(b)\n        raise\n",
    "def new(a, b, c, d):\n    return 1\n",
)


def _drift(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = spread(table(spark, d, "part")).select(said("g", F.col("p_partkey")).alias("path"), F.col("p_partkey").alias("key"))
    alike = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(_ALIKE.format(n)).alias("content")) for n in ("one", "two", "three", "four")])
    return part.select("path", F.lit("new").alias("name"), pick(F.col("key"), *_KINDS).alias("content")), part.select("path", F.inline(alike))


@query("""WITH k AS (SELECT 'g' || p_partkey AS affected_file, p_partkey % 6 AS kind FROM part),
f AS (SELECT affected_file, kind, unnest(CASE kind WHEN 1 THEN ['return-style-drift'] WHEN 2 THEN ['exception-flow-drift'] WHEN 3 THEN ['helper-call-drift'] WHEN 4 THEN ['signature-shape-drift'] WHEN 5 THEN ['return-style-drift', 'exception-flow-drift', 'helper-call-drift', 'signature-shape-drift'] ELSE [] END) AS matched_pattern FROM k)
SELECT affected_file, 'new' AS affected_symbol, matched_pattern, CASE WHEN kind = 5 AND matched_pattern IN ('return-style-drift', 'exception-flow-drift') THEN 'error' ELSE 'warning' END AS severity,
CASE WHEN kind = 5 AND matched_pattern IN ('return-style-drift', 'exception-flow-drift') THEN 'failed' ELSE 'warning' END AS validation_status,
CASE matched_pattern WHEN 'return-style-drift' THEN 'new returns int, similar symbols return dict' WHEN 'exception-flow-drift' THEN 'exception handling differs from similar symbols' WHEN 'helper-call-drift' THEN 'missing calls of similar symbols: check, log' ELSE '4 parameters, similar symbols have 2' END AS reason FROM f""")
def pattern_findings(spark, d):
    """EXT10, FLT5, AGG24, AGG25, SET2, GR11: how new symbols of six kinds differ from the others of their files."""
    return patterns.detect(*_drift(spark, d)).drop("suggested_fix")


_LABELLED = "round(list_cosine_similarity(list_concat(a.embedding::DOUBLE[], [CASE WHEN i = a.label THEN 1.0 ELSE 0.0 END FOR i IN range(64)]::DOUBLE[]), list_concat(b.embedding::DOUBLE[], [CASE WHEN i = b.label THEN 1.0 ELSE 0.0 END FOR i IN range(64)]::DOUBLE[])), 6)"
_SIMILAR = f"""near AS (SELECT query, vec_id, score FROM (SELECT a.vec_id AS query, b.vec_id, {_LABELLED} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_LABELLED} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 6),
beside AS (SELECT query, vec_id + 1 AS vec_id, 0.8 * score AS score FROM near WHERE vec_id + 1 IN (SELECT vec_id FROM embeddings) UNION ALL SELECT query, vec_id - 1, 0.8 * score FROM near WHERE vec_id - 1 IN (SELECT vec_id FROM embeddings)),
best AS (SELECT query, vec_id, max(score) AS score FROM (SELECT * FROM near UNION ALL SELECT * FROM beside) WHERE vec_id <> query AND score >= 0.45 GROUP BY ALL),
five AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, 's' || vec_id) AS rank FROM best)"""


@query(f"WITH {_SIMILAR} SELECT 'g' || query AS path, 's' || vec_id AS name, round(score, 6) AS score, rank FROM five WHERE rank <= 5")
def pattern_similar(spark, d):
    """GR11: candidates of every symbol whose number is divisible by 50: its nearest by the stored lists of vectors, and what these call or are called by."""
    return patterns.candidates(drift.similar(*_near_symbols(spark, d), exact=True)).select("path", "name", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_SIMILAR}, k AS (SELECT query, (query // 50) % 6 AS kind, count(*) AS n, max(score) AS top FROM five WHERE rank <= 5 GROUP BY query),
f AS (SELECT *, unnest(list_filter(CASE kind WHEN 1 THEN ['return-style-drift'] WHEN 2 THEN ['exception-flow-drift'] WHEN 3 THEN ['helper-call-drift'] WHEN 4 THEN ['signature-shape-drift'] WHEN 5 THEN ['return-style-drift', 'exception-flow-drift', 'helper-call-drift', 'signature-shape-drift'] ELSE [] END, lambda x: n > 1 OR x <> 'helper-call-drift')) AS matched_pattern FROM k)
SELECT 'g' || query AS affected_file, matched_pattern, CASE WHEN kind = 5 AND matched_pattern IN ('return-style-drift', 'exception-flow-drift') THEN 'error' ELSE 'warning' END AS severity FROM f""")
def pattern_drift(spark, d):
    """GR11: vector hits and their neighbours as one plan with what they show of the changed symbols."""
    return drift.findings(*_near_symbols(spark, d), exact=True).select("affected_file", "matched_pattern", "severity")


def _near_symbols(spark: SparkSession, d: str) -> tuple:
    """Changed symbols of six kinds, an index of vectors that say the label as well, all symbols by vec_id, each alike, and calls of each to the next."""
    label = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i == F.col("label"), 1.0).otherwise(0.0))
    vectors, key = table(spark, d, "embeddings").withColumn("embedding", F.concat(F.col("embedding").cast("array<double>"), label)), F.col("vec_id")
    index = once(spark, "labelled", d, lambda: vector_index.build(vectors, shared_path(spark, "labelled")))
    changed = vectors.filter(key % 50 == 0).select(key.alias("key"), said("g", key).alias("path"), said("s", key).alias("name"), pick(F.floor(key / 50), *_KINDS).alias("content"), "embedding")
    symbols = vectors.select(key.alias("key"), key.cast("string").alias("id"), said("s", key).alias("name"), F.lit(_ALIKE.format("one")).alias("content"))
    edges = vectors.select(key.cast("string").alias("src"), (key + 1).cast("string").alias("dst"), F.lit("CALLS").alias("type"))
    return changed, index, symbols, edges


@query("""SELECT 'g' || p_partkey AS path, 'new' AS symbol, 'dict' AS return_style, true AS has_try_except, 2 AS parameter_count, 'check,log' AS calls, CAST(0.58 AS DOUBLE) AS score, 'four,one,three,two' AS examples FROM part""")
def pattern_conventions(spark, d):
    """AGG23: what the candidates of each new symbol have in common."""
    rows = patterns.conventions(patterns.candidates(patterns.siblings(*_drift(spark, d))))
    return rows.select("path", "symbol", "return_style", "has_try_except", "parameter_count", F.array_join(F.array_sort("common_calls"), ",").alias("calls"), "score", F.array_join("examples", ",").alias("examples"))


@query("""SELECT 'g' || p_partkey AS path, unnest(['one', 'four', 'three', 'two']) AS name, unnest([0.9::DOUBLE, 0.58, 0.58, 0.58]) AS score, unnest([1, 2, 3, 4]) AS rank FROM part""")
def pattern_candidates(spark, d):
    """WIN4, FLT5: of one name the better candidate, and none below the least score."""
    new, alike = _drift(spark, d)
    extra = F.array(F.struct(F.lit("one").alias("name"), F.lit(0.9).alias("score")), F.struct(F.lit("low").alias("name"), F.lit(0.3).alias("score")))
    similar = new.select("path", F.col("name").alias("symbol"), F.inline(extra)).select("path", "symbol", "name", F.lit("").alias("content"), "score")
    return patterns.candidates(similar, patterns.siblings(new, alike)).select("path", "name", "score", "rank")


@query("""WITH n AS (SELECT p_brand AS path, p_partkey AS symbol, b.p_partkey AS name FROM part a JOIN (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS n FROM part) b USING (p_brand) WHERE b.n <= 9 AND a.p_partkey <> b.p_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY path, symbol ORDER BY name) AS rank FROM n) SELECT path, lpad(CAST(symbol AS VARCHAR), 9, '0') AS symbol, lpad(CAST(name AS VARCHAR), 9, '0') AS name FROM r WHERE rank <= 8""".replace("p_partkey AS symbol", "a.p_partkey AS symbol"))
def sibling_limit(spark, d):
    """JN14, TOP4: up to eight other parts of each part's brand, by name."""
    rows = table(spark, d, "part").select(F.col("p_brand").alias("path"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("name"), F.lit("").alias("content"))
    return patterns.siblings(rows, rows).select("path", "symbol", "name")


# --- versions of a text: an order's lines, with lines added, removed or replaced -------------------------------------------------


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """(key, n, old, new): n lines; kind 0 is the same, 1 has lines more, 2 lost its last line, 3 has two other lines for the first."""
    key = F.col("o_orderkey")
    n = (key % 7 + 3).cast("int")
    line = lambda i: said("l", i)
    old = F.transform(F.sequence(F.lit(1), n), line)
    new = pick(key, old, F.concat(old, F.transform(F.sequence(F.lit(1), (key % 3 + 1).cast("int")), lambda i: said("new", i))), F.slice(old, 1, n - 1), F.concat(F.array(F.lit("x"), F.lit("y")), F.slice(old, 2, n)))
    return table(spark, d, "orders").select(key.alias("key"), n.alias("n"), F.array_join(old, "\n").alias("old"), F.array_join(new, "\n").alias("new"))


_VERSIONS = """v AS (SELECT o_orderkey AS key, o_orderkey % 7 + 3 AS n, o_orderkey % 4 AS kind, CASE o_orderkey % 4 WHEN 1 THEN o_orderkey % 3 + 1 ELSE 0 END AS added, CASE o_orderkey % 4 WHEN 2 THEN 1 ELSE 0 END AS removed, CASE o_orderkey % 4 WHEN 3 THEN 2 ELSE 0 END AS modified FROM orders),
r AS (SELECT *, CASE kind WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE * n / (2 * n + added) WHEN 2 THEN 2.0::DOUBLE * (n - 1) / (2 * n - 1) ELSE 2.0::DOUBLE * (n - 1) / (2 * n + 1) END AS ratio FROM v)"""


@query(f"""WITH {_VERSIONS} SELECT key, CAST(added AS BIGINT) AS lines_added, CAST(removed AS BIGINT) AS lines_removed, CAST(modified AS BIGINT) AS lines_modified, CAST(added + removed + modified AS BIGINT) AS total_changes, round(ratio, 4) AS similarity_ratio, kind = 0 AS is_identical,
round(ratio, 4) < 0.85 AND kind <> 0 AS significant FROM r""")
def diff_stats(spark, d):
    """TXT6, FLT8: counted changes of versions, and whether they are significant."""
    rows = _versions(spark, d).select("key", text.diff_stats(F.col("old"), F.col("new")).alias("s"))
    return rows.select("key", "s.*", text.significant(F.col("s")).alias("significant"))


@query("""SELECT o_orderkey AS key, '--- a/o' || o_orderkey || chr(10) || '+++ b/o' || o_orderkey || chr(10) || '@@ -1,3 +1,3 @@' || chr(10) || ' a' || chr(10) || '-b' || o_orderkey || chr(10) || '+c' || o_orderkey || chr(10) || ' d' || chr(10) AS patch, CAST(1 AS BIGINT) AS hunk, 2 AS old_line, 2 AS new_line FROM orders""")
def unified_diffs(spark, d):
    """TXT5, SRC14, SNK4: unified diffs, saved and loaded as patches, and their hunks."""
    key = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(said("o", key).alias("path"), text.diff(said("a\nb", key, "\nd\n"), said("a\nc", key, "\nd\n"), said("o", key)).alias("patch"))
    from brindle.sources.sinks import load_patches, save_patches

    folder = shared_path(spark, "patches")
    save_patches(rows, folder)
    patches = load_patches(spark, folder)
    found = hunks.parse_hunks(patches).select("path", "hunk", F.col("changedOldLines")[0].alias("old_line"), F.col("changedNewLines")[0].alias("new_line"))
    return patches.join(found, "path").select(F.substr("path", F.lit(2)).cast("long").alias("key"), "patch", "hunk", "old_line", "new_line")


@query("""SELECT o_orderkey AS path, CASE WHEN o_orderkey % 100 + rn <= 50 THEN 'a' ELSE 'b' END AS name, string_agg(CAST(o_orderkey % 100 + rn AS VARCHAR), ',' ORDER BY rn) AS lines
FROM orders JOIN (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rn FROM lineitem) ON l_orderkey = o_orderkey GROUP BY ALL""")
def changed_symbols(spark, d):
    """JN13, SET5: two symbols of each order's file, up to line 50 and behind it, and the changed lines that fall into them."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    first = (F.col("path") % 100).cast("int") + 1
    found = lines.select("path", F.sequence(first, first + F.col("n") - 1).alias("changedNewLines"))
    two = F.array(*[F.struct(F.lit(n).alias("name"), F.lit("function").alias("type"), F.lit(a).alias("start_line"), F.lit(b).alias("end_line")) for n, a, b in (("a", 1, 50), ("b", 51, 200))])
    on = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.inline(two))
    return hunks.changed_symbols(found, on).select("path", "name", F.array_join("changedLines", ",").alias("lines"))


# --- the graph in place, retrieval with context ---------------------------------------------------------------------------------


@query("""SELECT 's' || s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'new' || s_suppkey WHEN 1 THEN 'again' ELSE 'old' END AS signature, CASE WHEN s_suppkey % 3 = 1 THEN 'says' END AS docstring, CASE s_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS invalidated FROM supplier""")
def modify_symbols(spark, d):
    """GR6: suppliers as functions, a third with a new signature, a third with two changes, of which the later counts."""
    g = _graph(spark, d)
    nodes = g.nodes.withColumn("signature", F.lit("old"))
    key = F.col("s_suppkey")
    row = lambda at, signature, docstring, invalidated: F.struct(F.lit(at).alias("modified_at"), signature.alias("signature"), F.lit(docstring).cast("string").alias("docstring"), F.lit(invalidated).alias("invalidated"))
    later = F.array(row("2024-01-01", said("lost"), None, True), row("2024-01-02", said("again"), "says", False))
    steps = F.when(key % 3 == 0, F.array(row("2024-01-01", said("new", key), None, True))).when(key % 3 == 1, later)
    changed = table(spark, d, "supplier").select(said("s", key).alias("path"), F.col("s_name").alias("name"), F.inline(steps))
    return graph.modify(graph.Graph(nodes, g.edges), changed).nodes.filter("label = 'Function'").select("id", "signature", "docstring", "invalidated")


def _neighbourhoods(spark: SparkSession, d: str) -> context.Context:
    """The stored neighbourhoods of suppliers and parts, as a question meets them; made by the first query of a session that needs them."""

    def make() -> context.Context:
        g = _graph(spark, d, distinct=False)  # neighbours are told apart by name
        return context.build(graph.Graph(g.nodes.withColumns({"content": F.lit(""), "start_line": F.lit(1)}), g.edges), shared_path(spark, "context"))

    return once(spark, "context", d, make)


@query(f"""WITH {_HYBRID}, {_GRAPH}, named AS (SELECT name AS hit, score, 'Supplier#' || lpad(CAST(name AS VARCHAR), 9, '0') AS symbol FROM hits)
SELECT symbol AS name, score, count(DISTINCT p.name) AS neighbours, min(p.name) AS first FROM named JOIN nodes s ON s.name = symbol LEFT JOIN edges e ON e.src = s.id AND e.type = 'CALLS' LEFT JOIN nodes p ON p.id = e.dst GROUP BY symbol, score""")
def retrieve_context(spark, d):
    """GR3: the hits of keywords and vectors, as suppliers of that number, with the parts that they call."""
    keyword = document_index(spark, d).top(QUESTION, 50).withColumnRenamed("key", "name")
    vectors = table(spark, d, "embeddings")
    one = vectors.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    near = search.top(vectors.join(F.broadcast(one)).select(F.col("vec_id").alias("name"), F.round(search.cosine(F.col("embedding"), F.col("q")), 6).alias("score")), 50, "name")
    hits = search.top(search.hybrid(near, keyword).select("name", F.round("score", 6).alias("score")), 20, "name")
    hits = hits.select(F.concat(F.lit("Supplier#"), F.lpad(F.col("name").cast("string"), 9, "0")).alias("name"), "score")
    found = retrieval.with_context(_neighbourhoods(spark, d), hits)
    return found.select("name", "score", F.size("neighbours").cast("long").alias("neighbours"), F.array_min("neighbours.name").alias("first"))


# --- the maintenance loop: suppliers as files, changed in two batches ------------------------------------------------------------


def _changes(spark: SparkSession, d: str, batch: int) -> DataFrame:
    """Batch 0 adds a file for each supplier. Batch 1 modifies those whose keys end in 0 to 2, deletes 3, renames 4, and says of 5 that it changed, but not how."""
    key = F.col("s_suppkey")
    path, end = said("s", key, ".py"), key % 10
    rows = spread(table(spark, d, "supplier"))
    if batch == 0:
        made = rows.select(path.alias("file_path"), F.lit("added").alias("change_type"), F.lit(None).cast("string").alias("old_path"), said("def f", key, "():\n    f", key + 1, "()\n").alias("content"))
    else:
        kind = F.when(end <= 2, "modified").when(end == 3, "deleted").when(end == 4, "renamed").otherwise("modified")
        made = rows.filter(end <= 5).select(
            F.when(end == 4, said("r", key, ".py")).otherwise(path).alias("file_path"), kind.alias("change_type"), F.when(end == 4, path).alias("old_path"),
            F.when(end <= 2, said("def g", key, "():\n    f", key, "()\n")).alias("content"),
        )
    return made.withColumn("ts", F.timestamp_seconds(F.lit(batch)))


def _maintained(spark: SparkSession, d: str) -> Store:
    def make() -> Store:
        store = Store(spark, shared_path(spark, "loop"))
        for batch in (0, 1, 1):  # the last is a retry
            loop.apply_changes(store, _changes(spark, d, batch), batch=batch)
        return store

    return once(spark, "loop", d, make)


@query("""SELECT CASE s_suppkey % 10 WHEN 4 THEN 'r' ELSE 's' END || s_suppkey || '.py' AS path, CASE WHEN s_suppkey % 10 <= 2 THEN 'g' ELSE 'f' END || s_suppkey AS name FROM supplier WHERE s_suppkey % 10 <> 3""")
def loop_symbols(spark, d):
    """STR3, GR7: what the extraction table holds after two batches and a retry."""
    return symbols.snapshot(_maintained(spark, d).read("extracted")).select("path", "name")


@query("""SELECT 's' || s_suppkey || '.py' AS path, 'f' || s_suppkey AS name, 'removed' AS change_type FROM supplier WHERE s_suppkey % 10 <= 4 UNION ALL SELECT 's' || s_suppkey || '.py', 'g' || s_suppkey, 'added' FROM supplier WHERE s_suppkey % 10 <= 2
UNION ALL SELECT 'r' || s_suppkey || '.py', 'f' || s_suppkey, 'added' FROM supplier WHERE s_suppkey % 10 = 4""")
def loop_changes(spark, d):
    """STR3: the symbol changes of the second batch, once although it was tried twice."""
    return _maintained(spark, d).read("symbol_changes", ["1"]).select("path", "name", "change_type")


@query("""SELECT CASE s_suppkey % 5 WHEN 0 THEN 'y' WHEN 1 THEN 'x' WHEN 2 THEN 'n' WHEN 3 THEN 's' END || s_suppkey || '.py' AS path, CASE s_suppkey % 5 WHEN 0 THEN 'f' WHEN 1 THEN 'g' WHEN 2 THEN 'h' WHEN 3 THEN 'g' END || s_suppkey AS name FROM supplier WHERE s_suppkey % 5 <> 4""")
def loop_renames(spark, d):
    """STR3: renames without content within a batch: twice in a row, behind a change, of a new file, of what was renamed away and came again, and of what was deleted."""
    key, none = F.col("s_suppkey"), F.lit(None).cast("string")
    rows, code = spread(table(spark, d, "supplier")), lambda name: said("def ", name, key, "():\n    pass\n")
    step = lambda ts, path, kind, old=None, content=none: F.struct(said(path, key, ".py").alias("file_path"), F.lit(kind).alias("change_type"), F.timestamp_seconds(F.lit(ts)).alias("ts"), (said(old, key, ".py") if old else none).alias("old_path"), content.alias("content"))
    store = Store(spark, shared_path(spark, "renames"))
    loop.apply_changes(store, rows.select(F.inline(F.array(step(0, "s", "added", None, code("f"))))), batch=0)
    moves = {
        0: [step(1, "x", "renamed", "s"), step(2, "y", "renamed", "x")],
        1: [step(1, "s", "modified", None, code("g")), step(2, "x", "renamed", "s")],
        2: [step(1, "m", "added", None, code("h")), step(2, "n", "renamed", "m"), step(3, "s", "deleted")],
        3: [step(1, "x", "renamed", "s"), step(2, "s", "added", None, code("g")), step(3, "x", "deleted")],
        4: [step(1, "s", "deleted"), step(2, "x", "renamed", "s")],
    }
    every = rows.select(F.inline(F.array(*moves[4])), key.alias("k")).limit(0)
    for rest, steps in moves.items():
        every = every.unionByName(rows.filter(key % 5 == rest).select(F.inline(F.array(*steps)), key.alias("k")))
    loop.apply_changes(store, every.drop("k"), batch=1)
    return symbols.snapshot(store.read("extracted")).select("path", "name")


@query("""WITH f AS (SELECT count(*) AS n FROM supplier WHERE s_suppkey % 10 <> 3) SELECT 'CONTAINS' AS type, n FROM f UNION ALL SELECT 'DEFINES', n FROM f
UNION ALL SELECT 'CALLS', count(*) FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 WHERE a.s_suppkey % 10 BETWEEN 4 AND 8""")
def loop_graph(spark, d):
    """GR8, SNK1: the graph after these batches, stored in one step and counted."""
    store = _maintained(spark, d)
    if not store.exists("edges"):
        loop.publish(store)
    return graph.type_counts(store.read("edges"))


@query("""WITH f AS (SELECT count(*) AS n FROM supplier WHERE s_suppkey % 10 <> 3) SELECT 'CONTAINS' AS type, n FROM f UNION ALL SELECT 'DEFINES', n FROM f
UNION ALL SELECT 'CALLS', count(*) FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 WHERE a.s_suppkey % 10 BETWEEN 4 AND 8""")
def delta_graph(spark, d):
    """GR7, GR8: the graph after these batches, kept by deltas and not built."""
    store, config = Store(spark, shared_path(spark, "deltas")), loop.Config(maintain=True)
    for batch in (0, 1):
        loop.apply_changes(store, _changes(spark, d, batch), config, batch=batch)
    return graph.type_counts(loop.graph(store, config).edges)


@query("""SELECT 's' || s_suppkey || '.py' AS path, 'f' || s_suppkey AS name FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT 's' || s_suppkey || '.py', 'h' || s_suppkey FROM supplier WHERE s_suppkey % 4 = 0""")
def update_files(spark, d):
    """GR7: extracted files, of which a fourth are replaced."""
    key = F.col("s_suppkey")
    suppliers = spread(table(spark, d, "supplier"))
    of = lambda rows, name: extract(rows.select(said("s", key, ".py").alias("path"), said("def ", name, key, "():\n    pass\n").alias("content")))
    merged, _ = graph.update_files(of(suppliers.filter(key % 4 == 0), "h"), of(suppliers, "f"))
    return symbols.snapshot(merged).select("path", "name")


@query("SELECT count(*) AS processed, CAST(0 AS BIGINT) AS failed, count(*) AS symbols, 'n' || lpad(CAST(max(n_nationkey) AS VARCHAR), 2, '0') || '.py' AS last_file, false AS running FROM nation")
def watched_stream(spark, d):
    """SRC7, STR1, STR4, AGG31: nations as files that a stream watches, and what its loop counted."""
    key = F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    rows = table(spark, d, "nation").select(said("n", key, ".py").alias("file_path"), F.lit("added").alias("change_type"), F.timestamp_seconds("n_nationkey").alias("ts"), F.lit(None).cast("string").alias("old_path"), said("def n", key, "():\n    pass\n").alias("content"))
    landing = shared_path(spark, "landing")
    rows.unionByName(rows.withColumn("file_path", F.lit("notes.txt"))).coalesce(1).write.json(landing)
    runner = loop.MaintenanceLoop(lambda: changes.watch(spark, landing), Store(spark, shared_path(spark, "watched")), shared_path(spark, "watching"))
    runner.start(available_now=True).awaitTermination()
    status = runner.status()
    return spark.createDataFrame([tuple(status[c] for c in ("processed", "failed", "symbols", "last_file", "running"))], "processed long, failed long, symbols long, last_file string, running boolean")


@query("""SELECT file_path, n, CASE WHEN place <= 10 THEN 'taken' ELSE 'waits' END AS state FROM (SELECT 's' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS file_path, s_suppkey AS n, row_number() OVER (ORDER BY s_suppkey) AS place FROM supplier)""")
def change_queue(spark, d):
    """STR2, AGG32: suppliers as changes that wait, of which the first ten are taken."""
    queue = loop.ChangeQueue(Store(spark, shared_path(spark, "queue")))
    queue.add(table(spark, d, "supplier").select(said("s", F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("file_path"), F.lit("added").alias("change_type"), F.timestamp_seconds("s_suppkey").alias("ts")))
    taken = queue.consume(10).select("file_path", F.lit("taken").alias("state"))
    rows = taken.unionByName(queue.pending().select("file_path", F.lit("waits").alias("state")))
    return rows.select("file_path", F.substr("file_path", F.lit(2)).cast("long").alias("n"), "state")


@query("SELECT event_type AS change_type, count(*) AS n FROM events GROUP BY event_type")
def change_counts(spark, d):
    """AGG32: events as changes that wait, by type."""
    return loop.queue_status(table(spark, d, "events").select(F.col("event_type").alias("change_type")))


@query("""SELECT event_id, epoch_us(ts) // 1000 AS epoch_ms, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1000000 AS seconds_since FROM events""")
def change_times(spark, d):
    """DAT1: the time of each event in milliseconds, and the seconds since its user's event before."""
    return changes.times(table(spark, d, "events"), "user_id", "event_id").select("event_id", "epoch_ms", "seconds_since")


@query("""SELECT 'a' || s_suppkey || '.py' AS path, 's' || s_nationkey AS content FROM supplier WHERE s_nationkey % 2 = 0""")
def files_at_revision(spark, d):
    """SRC5: suppliers as files of two revisions, by nation."""
    rows = table(spark, d, "supplier").select(said("r", F.col("s_nationkey") % 2).alias("rev"), said("a", F.col("s_suppkey"), ".py").alias("path"), said("s", F.col("s_nationkey")).alias("content"))
    return files.files_at(rows, "r0")


@query("""SELECT 'src/p' || p_partkey || '.py' AS path, 'f' || p_partkey AS name, 'm' || p_partkey % 10 AS module FROM part""")
def saved_analysis(spark, d):
    """SRC3: an analysis saved as JSON and read again."""
    folder = shared_path(spark, "analysis")
    files.write_analysis(extracted(spark, d), folder)
    return files.read_analysis(spark, folder).select("path", F.col("functions.name")[0].alias("name"), F.col("imports.module")[0].alias("module"))
