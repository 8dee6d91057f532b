"""Sources, reports of tools, sinks, traces, coverage and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import paths
from brindle.operators import commit, coverage, graph, trace, validation
from brindle.plans import dynamic
from brindle.queries.base import once, query, spread, stored, table
from brindle.queries.code import pick, said
from brindle.queries.core import _PAIRS, _calls, _pairs, _stages, _trace
from brindle.session import shared_path
from brindle.sources import changes, files, reports
from brindle.sources.sinks import Store

# --- sources ----------------------------------------------------------------------------------------------------------------


@query("SELECT 'c' || c_nationkey AS folder, count(*) AS lines, CAST(sum(c_custkey) AS BIGINT) AS total FROM customer GROUP BY c_nationkey")
def directory(spark, d):
    """SRC1: customers written as text files in a folder for each nation, and read as whole files."""
    folder = shared_path(spark, "directory")
    table(spark, d, "customer").select(said("c", F.col("c_nationkey")).alias("folder"), F.col("c_custkey").cast("string").alias("value")).write.partitionBy("folder").text(folder)
    lines = files.load_directory(spark, folder, "*.txt").select(F.regexp_extract("path", "folder=([^/]*)/", 1).alias("folder"), F.explode(F.split("content", "\n")).alias("line")).filter("line <> ''")
    return lines.groupBy("folder").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("line").cast("long")).alias("total"))


@query("SELECT r_name || '.py' AS path, 'x = ' || r_regionkey AS content FROM region")
def inline_files(spark, d):
    """SRC2: the five regions as files given inline."""
    rows = table(spark, d, "region").select(F.concat("r_name", F.lit(".py")).alias("path"), said("x = ", F.col("r_regionkey")).alias("content"))
    return files.from_records(spark, [r.asDict() for r in rows.limit(5).collect()])


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS watched, CASE o_orderkey % 5 WHEN 1 THEN true ELSE false END AS is_test FROM orders""")
def watched_paths(spark, d):
    """FLT3, TXT8: which paths are watched: by extension, and not in an ignored folder."""
    key = F.col("o_orderkey")
    path = pick(key, said("src/o", key, ".py"), said("tests/o", key, ".py"), said(".git/o", key, ".py"), said("src/o", key, ".txt"), said("a/node_modules/b/o", key, ".pyi"))
    return table(spark, d, "orders").select("o_orderkey", paths.watched(path).alias("watched"), paths.is_test(path).alias("is_test"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 50 END AS additions, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 7 END AS deletions, CASE WHEN o_orderkey % 2 = 0 THEN 'python' ELSE 'other' END AS language,
CASE WHEN o_orderkey % 4 = 0 THEN 'renamed' ELSE 'modified' END AS change_type FROM orders""")
def staged_files(spark, d):
    """SRC15, SRC6: orders as staged files: a line of status and a line of counts each, some of them binary or renamed."""
    key = F.col("o_orderkey")
    end = F.when(key % 2 == 0, ".py").otherwise(".md")
    orders = table(spark, d, "orders")
    moved = key % 4 == 0
    status = changes.name_status(orders.select(F.when(moved, said("R90\told/", key, end, "\tnew/", key, end)).otherwise(said("M\tnew/", key, end)).alias("value")))
    shown = F.when(moved, said("{old => new}/", key, end)).otherwise(said("new/", key, end))
    counted = changes.numstat(orders.select(F.when(key % 3 == 0, said("-\t-\t", shown)).otherwise(said(key % 50, "\t", F.col("o_custkey") % 7, "\t", shown)).alias("value")))
    rows = changes.staged_files(status, counted)
    return rows.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("id"), F.col("additions").cast("long").alias("additions"), F.col("deletions").cast("long").alias("deletions"), "language", "change_type")


# --- reports ----------------------------------------------------------------------------------------------------------------


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    """What a profiler printed for each user: a line of noise, and a trace of the user's events as JSON; users divisible by 5 print noise alone."""
    event = F.struct(F.lit("call").alias("event"), F.col("event_type").alias("func"), F.lit("m").alias("module"), F.lit(1).alias("line"), F.lit(0).alias("depth"), F.array(F.col("event_type")).alias("arg_types"))
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg(F.collect_list(event).alias("events"), F.count(F.lit(1)).alias("n"))
    counts = F.create_map(F.lit("main->run"), F.col("n"), F.lit("<module>->main"), F.lit(1).cast("long"), F.lit("broken"), F.lit(7).cast("long"), said("run -> f", F.col("run") % 3), F.lit(2).cast("long"))
    line = F.to_json(F.struct("events", counts.alias("call_counts"), F.lit(0).alias("exit_code")))
    return rows.select("run", F.when(F.col("run") % 5 == 0, "noise").otherwise(said("noise\n", line)).alias("stdout"))


@query("""SELECT user_id AS run, CASE WHEN user_id % 5 = 0 THEN 0 ELSE count(*) END AS events, CASE WHEN user_id % 5 = 0 THEN -1 ELSE 0 END AS exit_code FROM events GROUP BY user_id""")
def trace_reports(spark, d):
    """SRC8, JSN1: traces in the output of a profiler; an empty one where there is none."""
    found = reports.trace(_outputs(spark, d))
    n = reports.trace_events(found).groupBy("run").agg(F.count(F.lit(1)).alias("events"))
    return found.select("run", "exit_code").join(n, "run", "left").select("run", F.coalesce("events", F.lit(0)).alias("events"), "exit_code")


@query("""WITH u AS (SELECT user_id, count(*) AS n FROM events WHERE user_id % 5 <> 0 GROUP BY user_id) SELECT 'main' AS caller, 'run' AS callee, CAST(sum(n) AS BIGINT) AS n FROM u UNION ALL SELECT 'run', 'f' || user_id % 3, CAST(2 * count(*) AS BIGINT) FROM u GROUP BY ALL""")
def counted_pairs(spark, d):
    """FLT1, TXT14: counted calls of those traces, without markers and broken keys."""
    return trace.counted_pairs(reports.trace(_outputs(spark, d)))


@query("""SELECT l_orderkey AS run, 'src/f' || l_orderkey || '.py' AS path, count(DISTINCT l_linenumber) FILTER (WHERE l_returnflag = 'R') AS executed, count(DISTINCT l_linenumber) FILTER (WHERE l_returnflag <> 'R') AS missing, 0 AS excluded FROM lineitem GROUP BY l_orderkey""")
def coverage_reports(spark, d):
    """SRC9: coverage reports as JSON, one for each order."""
    of = lambda when: F.collect_set(F.when(when, F.col("l_linenumber")))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(of(F.col("l_returnflag") == "R").alias("executed_lines"), of(F.col("l_returnflag") != "R").alias("missing_lines"))
    path = said("src/f", F.col("run"), ".py")
    made = rows.select("run", F.to_json(F.struct(F.create_map(path, F.struct("executed_lines", "missing_lines")).alias("files"))).alias("json"))
    return reports.coverage(made).select("run", "path", F.size("executed_lines").cast("long").alias("executed"), F.size("missing_lines").cast("long").alias("missing"), F.size("excluded_lines").alias("excluded"))


@query("""SELECT event_id, user_id AS line, CASE event_id % 3 WHEN 0 THEN 'E501' WHEN 1 THEN 'W291' ELSE 'X100' END AS code, event_type AS message, CASE event_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'note' END AS severity FROM events""")
def lint_json(spark, d):
    """SRC10, TXT7: a linter's findings as JSON."""
    item = F.struct(F.concat(F.col("event_id").cast("string"), F.lit(".py")).alias("filename"), F.struct(F.col("user_id").cast("int").alias("row"), F.lit(1).alias("column")).alias("location"), pick(F.col("event_id"), "E501", "W291", "X100").alias("code"), F.col("event_type").alias("message"))
    rows = table(spark, d, "events").groupBy((F.col("event_id") % 100).alias("run")).agg(F.to_json(F.collect_list(item)).alias("stdout"))
    return reports.lint(rows).select(F.regexp_extract("file", r"(\d+)", 1).cast("long").alias("event_id"), F.col("line").cast("long").alias("line"), "code", "message", "severity")


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'PASSED' ELSE 'SKIPPED' END"


@query(f"SELECT o_custkey AS run, 't/test_' || o_custkey || '.py' AS file, 'test_' || o_orderkey AS test, {_STATUS} AS status FROM orders")
def test_results(spark, d):
    """SRC13: orders as tests of a verbose run of their customer."""
    status = F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "O", "PASSED").otherwise("SKIPPED")
    line = said("t/test_", F.col("o_custkey"), ".py::test_", F.col("o_orderkey"), " ", status, " [ 5%]")
    return reports.test_results(table(spark, d, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.array_join(F.collect_list(line), "\n").alias("stdout")))


# --- sinks ------------------------------------------------------------------------------------------------------------------


@query("""SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM nation UNION ALL SELECT n_nationkey + 1000, 'new' FROM nation WHERE n_nationkey % 3 = 0""")
def store_upsert(spark, d):
    """SNK1, SNK2: nations written whole; a third of them, and as many others, upserted."""
    store, nation = Store(spark, shared_path(spark, "upsert")), table(spark, d, "nation")
    rows = nation.select(F.col("n_nationkey").alias("id"), F.lit("old").alias("state"))
    store.write("t", rows)
    third = nation.filter("n_nationkey % 3 = 0").select(F.explode(F.array(F.col("n_nationkey"), F.col("n_nationkey") + 1000).cast(f"array<{rows.schema['id'].dataType.simpleString()}>")).alias("id"), F.lit("new").alias("state"))
    store.upsert("t", third, ["id"])
    return store.read("t")


@query("""SELECT count(*) AS created, (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0) AS updated, (SELECT count(*) FROM supplier) AS dropped, false AS left_over FROM supplier WHERE s_suppkey % 2 = 1""")
def store_reset(spark, d):
    """SNK5, SNK2: what an upsert and a reset report."""
    store, rows = Store(spark, shared_path(spark, "reset")), table(spark, d, "supplier").select("s_suppkey", "s_name")
    store.write("graph", rows.filter("s_suppkey % 2 = 0"))
    counts = store.upsert("graph", rows, ["s_suppkey"])
    dropped = store.reset("graph", "absent")
    return spark.createDataFrame([(counts["created"], counts["updated"], dropped["graph"] + dropped["absent"], store.exists("graph"))], "created long, updated long, dropped long, left_over boolean")


# --- traces in the graph ------------------------------------------------------------------------------------------------------

_KNOWN = "known AS (SELECT unnest(['click', 'view', 'signup']) AS name)"


def _known(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("click",), ("view",), ("signup",)], "name string")


@query(f"WITH {_PAIRS}, {_KNOWN} SELECT caller, callee, n FROM pairs WHERE caller IN (SELECT name FROM known) AND callee IN (SELECT name FROM known)")
def existing_pairs(spark, d):
    """JN10: pairs whose functions are known."""
    return trace.existing_pairs(_pairs(spark, d), _known(spark))


@query(f"WITH {_PAIRS}, {_KNOWN} SELECT DISTINCT f AS func FROM (SELECT caller AS f FROM pairs UNION SELECT callee FROM pairs) WHERE f NOT IN (SELECT name FROM known)")
def missing_functions(spark, d):
    """JN10: functions of pairs that are not known."""
    return trace.missing_functions(_pairs(spark, d), _known(spark))


@query("SELECT DISTINCT n_name AS name FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def callers_known(spark, d):
    """JN15: nations as functions that call their suppliers."""
    pairs = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("caller"), F.col("s_name").alias("callee"))
    return trace.callers_known(table(spark, d, "nation").select(F.col("n_name").alias("name")), pairs)


_CALLS_SQL = "c AS (SELECT 'f' || user_id AS func, event_type AS a0, CASE WHEN value > 50 THEN 'big' ELSE 'small' END AS a1 FROM events), fn AS (SELECT 'f' || c_custkey AS name FROM customer)"


def _enriched(spark: SparkSession, d: str) -> DataFrame:
    return trace.enrich_functions(table(spark, d, "customer").select(said("f", F.col("c_custkey")).alias("name")), _calls(spark, d))


@query(f"""WITH {_CALLS_SQL}, t AS (SELECT func, string_agg(DISTINCT t, ',' ORDER BY t) AS types FROM (SELECT func, a0 AS t FROM c UNION SELECT func, a1 FROM c) GROUP BY func), n AS (SELECT func, count(*) AS n_calls, count(DISTINCT a0 || a1) > 1 AS p FROM c GROUP BY func)
SELECT name, coalesce(types, 'none') AS types, n_calls, coalesce(p, false) AS is_polymorphic FROM fn LEFT JOIN t ON t.func = name LEFT JOIN n ON n.func = name""")
def enriched_functions(spark, d):
    """JN19: customers as functions, with the types that the events of a user of their number saw."""
    return _enriched(spark, d).select("name", F.coalesce(F.array_join("observed_types", ","), F.lit("none")).alias("types"), "n_calls", "is_polymorphic")


@query(f"""WITH {_CALLS_SQL}, s AS (SELECT * FROM c WHERE func IN (SELECT name FROM fn)) SELECT count(DISTINCT func) AS functions, (SELECT count(*) FROM (SELECT func FROM s GROUP BY func HAVING count(DISTINCT a0 || a1) > 1)) AS polymorphic,
(SELECT string_agg(DISTINCT t, ',' ORDER BY t) FROM (SELECT a0 AS t FROM s UNION SELECT a1 FROM s)) AS types FROM s""")
def enriched_overview(spark, d):
    """AGG35, FLT7, SET3: functions that were seen with types, and the union of those."""
    return trace.enriched_overview(_enriched(spark, d)).select("functions", "polymorphic", F.array_join("types", ",").alias("types"))


def _dynamic(spark: SparkSession, d: str) -> graph.Graph:
    """The events' functions as nodes that call each other as the trace says; tests and the coverage of two of them are added. Made once a session."""

    def make() -> graph.Graph:
        g, done, whole = _enriched_graph(spark, d)
        edges = stored(whole.edges, "dynamic")
        done.release()
        return graph.Graph(g.nodes, edges)

    return once(spark, "dynamic", d, make)


def _enriched_graph(spark: SparkSession, d: str) -> tuple[graph.Graph, dynamic.DynamicAnalysis, graph.Graph]:
    names = table(spark, d, "events").select(F.col("event_type").alias("name")).distinct()
    nodes = names.select(F.concat(F.lit("id-"), "name").alias("id"), F.lit("Function").alias("label"), "name", F.lit("m.py").alias("path"), F.current_timestamp().alias("updated_at"))
    edges = spark.createDataFrame([], "src string, dst string, type string, count long, updated_at timestamp")
    g = graph.Graph(nodes, edges)
    done = dynamic.analyze(g, _trace(spark, d).withColumn("arg_types", F.when(F.col("event") == "call", F.array(F.col("func")))))
    tests = graph.test_nodes(table(spark, d, "nation").select(said("tests/test_n", F.col("n_nationkey"), ".py").alias("path")))
    covered = coverage.coverage_edges(nodes.filter("name in ('click', 'view')").select("id"), tests.select("id"))
    return g, done, dynamic.enriched_graph(g, done, covered, tests)


@query(f"""WITH {_PAIRS} SELECT 'DYNAMICALLY_CALLS' AS type, count(*) AS n FROM pairs UNION ALL SELECT 'COVERED_BY', 2 UNION ALL SELECT 'HAS_TEST', count(*) FROM nation""")
def enriched_graph(spark, d):
    """GR10: the graph with runtime calls, coverage and tests."""
    return graph.type_counts(_dynamic(spark, d).edges)


@query(f"WITH {_PAIRS} SELECT count(*) AS edges, CAST(sum(n) AS BIGINT) AS total FROM pairs")
def edge_totals(spark, d):
    """AGG9: how many runtime edges there are, and the sum of their counts."""
    return graph.edge_totals(_dynamic(spark, d).edges)


@query("""SELECT 's' || s_suppkey AS src, 't' || n_nationkey AS dst, 'COVERED_BY' AS type FROM supplier, nation WHERE s_suppkey <= 50""")
def coverage_edges(spark, d):
    """JN8: suppliers as covered functions, nations as tests: joined by way of their suite, for the fifty functions that are asked for."""
    ids = table(spark, d, "supplier").select(said("s", F.col("s_suppkey")).alias("id"))
    edges = coverage.coverage_edges(ids, table(spark, d, "nation").select(said("t", F.col("n_nationkey")).alias("id")))
    return coverage.expanded_coverage(edges, ids.filter(F.substr("id", F.lit(2)).cast("int") <= 50))


@query("""SELECT DISTINCT 's' || s_suppkey AS src, 't' || n_nationkey AS dst, 'COVERED_BY' AS type FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def coverage_by_name(spark, d):
    """JN9: pairs of a supplier's and its nation's name, among the nodes of these names; and as many pairs of names that nothing has."""
    supplier, nation = table(spark, d, "supplier"), table(spark, d, "nation")
    pairs = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("function"), F.explode(F.array(F.col("n_name"), F.concat(F.lit("no "), "n_name"))).alias("test"))
    return coverage.coverage_edges_by_name(pairs, supplier.select(said("s", F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name")), nation.select(said("t", F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name")))


# --- validation and findings ----------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id AS patch, count(*) FILTER (WHERE (event_type = 'error' AND event_id % 3 = 0) OR (event_type = 'signup' AND event_id % 11 = 0)) = 0 AS ok FROM events GROUP BY user_id)
SELECT patch, ok AS constraints_passed, patch % 2 = 0 AND patch % 3 <> 0 AS tests_passed, ok AND patch % 2 = 0 AND patch % 3 <> 0 AS valid FROM e""")
def patch_verdicts(spark, d):
    """AGG28: users as patches; tests passed for even ones that 3 does not divide, and those that 3 divides had none."""
    rolled = validation.roll_up(_stages(spark, d))
    tests = rolled.filter("patch % 3 <> 0").select("patch", (F.col("patch") % 2 == 0).alias("all_passed"))
    return validation.verdict(rolled, tests)


@query("""SELECT 'o' || o_custkey AS affected_file, count(*) FILTER (WHERE o_orderstatus = 'P') AS info, CAST(0 AS BIGINT) AS note, count(*) FILTER (WHERE o_orderstatus = 'O') AS warning, count(*) FILTER (WHERE o_orderstatus = 'F') AS error, CAST(0 AS BIGINT) AS blocker FROM orders GROUP BY o_custkey""")
def findings_by_file(spark, d):
    """AGG33: orders as findings of their customer's file, by severity."""
    severity = F.when(F.col("o_orderstatus") == "F", "error").when(F.col("o_orderstatus") == "O", "warning").otherwise("info")
    return commit.by_file(table(spark, d, "orders").select(said("o", F.col("o_custkey")).alias("affected_file"), severity.alias("severity")))


@query("""SELECT count(*) AS stages, count(*) FILTER (WHERE n_nationkey % 4 <> 3) AS successful, count(*) FILTER (WHERE n_nationkey % 4 = 3) AS failed, CAST(sum(n_nationkey) AS DOUBLE) AS seconds, 'n' || min(n_nationkey) FILTER (WHERE n_nationkey % 4 = 3) AS first_failed FROM nation""")
def pipeline_metrics(spark, d):
    """AGG34: nations as stages, of which each fourth failed."""
    key = F.col("n_nationkey")
    return validation.pipeline_metrics(table(spark, d, "nation").select(key.alias("position"), said("n", key).alias("stage"), (key % 4 != 3).alias("ok"), key.cast("double").alias("seconds")))


@query("""SELECT o_custkey AS path, o_orderkey AS name, CAST(1 AS INTEGER) AS start_line FROM orders""")
def staged_symbols(spark, d):
    """WIN2, AGG20: the symbols of staged files, where each is listed twice and the first counts."""
    one = lambda content: F.struct(F.col("o_orderkey").cast("string").alias("name"), F.lit("function").alias("type"), F.lit(1).alias("startLine"), F.lit(content).alias("content"))
    staged = table(spark, d, "orders").select(F.col("o_custkey").alias("path"), F.array(one("first"), one("second")).alias("changedSymbols"))
    return commit.changed_symbols(staged).filter("content = 'first'").select("path", F.col("name").cast("long").alias("name"), "start_line")


@query("""SELECT 'p' || s_suppkey || '.py' AS affected_file, 'python-syntax-error' AS matched_pattern, 'blocker' AS severity FROM supplier WHERE s_suppkey % 4 = 1""")
def syntax_findings(spark, d):
    """AGG22: suppliers as staged files, of which each fourth does not parse."""
    key = F.col("s_suppkey")
    code = pick(key, said("x = ", key), said("def ("), said("# ", key), said("y = [", key, "]"))
    staged = spread(table(spark, d, "supplier")).select(said("p", key, ".py").alias("path"), F.lit("python").alias("language"), code.alias("newContent"))
    return commit.syntax_findings(staged).select("affected_file", "matched_pattern", "severity")
