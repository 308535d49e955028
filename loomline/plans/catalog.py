"""Named queries over the driver's tables, with SQL of the same result.

The tables hold no source code, so the operators here run over stand-ins for their input (queries
over real sources are in :mod:`loomline.plans.code`):
suppliers calling parts (line items are call sites), a user's events as the statements of a function (signup a source of
taint, error a cleaner, purchase a sink), lines of documents as source lines, turns of a
conversation as statements, orders as findings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.operators import findings, flow, relations
from loomline.plans import code, life
from loomline.sources.tables import table

_TOKEN = 'token = "[0-9a-f]{40}"'


def call_edges(spark: SparkSession, d: str) -> DataFrame:
    """A1: supplier to part as caller to callee, with sites: count, first and all lines."""
    return (
        table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey")
        .agg(F.count("*").alias("sites"), F.min("l_linenumber").alias("first_line"), F.array_join(F.sort_array(F.collect_list("l_linenumber")), ",").alias("lines"))
    )


def _calls(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return calls.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))


def callers(spark: SparkSession, d: str) -> DataFrame:
    """Who calls a part whose name contains a text."""
    return _calls(spark, d).where(F.col("p_name").contains("e")).select(F.col("s_name").alias("caller"), F.col("p_name").alias("callee")).distinct()


def callees(spark: SparkSession, d: str) -> DataFrame:
    """What a supplier whose name contains a text calls."""
    return _calls(spark, d).where(F.col("s_name").contains("7")).select(F.col("s_name").alias("caller"), F.col("p_name").alias("callee")).distinct()


def external_calls(spark: SparkSession, d: str) -> DataFrame:
    """A2: calls of what is not declared, counted."""
    known = table(spark, d, "part").where("p_size <= 25")
    return table(spark, d, "lineitem").join(known, F.col("l_partkey") == F.col("p_partkey"), "left_anti").groupBy("l_partkey").agg(F.count("*").alias("calls"))


def most_depended_on(spark: SparkSession, d: str) -> DataFrame:
    """The five nodes with most users, ties by name."""
    users = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("users"))
    return users.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "users").orderBy(F.desc("users"), "n_name").limit(5)


def dep_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Supplier to customer edges collapsed to nations, without own edges."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    edges = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return edges.where("src != dst").groupBy("src", "dst").agg(F.count("*").alias("calls"))


def stmt_edges(spark: SparkSession, d: str) -> DataFrame:
    """statement graph of straight code."""
    return flow.next_edges(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", F.col("turn").alias("src"), "dst", "role")


def reaching(spark: SparkSession, d: str) -> DataFrame:
    """The definition that reaches each sink."""
    e = table(spark, d, "events")
    e = e.withColumn("def_id", flow.last_before(F.col("event_id"), F.col("event_type").isin("signup", "error"), "user_id", "ts", "event_id"))
    return e.where("event_type = 'purchase' AND def_id IS NOT NULL").select("event_id", "user_id", "def_id")


def taint(spark: SparkSession, d: str) -> DataFrame:
    """sinks whose last definition is a source."""
    e = table(spark, d, "events")
    kind, at = (flow.last_before(F.col(c), F.col("event_type").isin("signup", "error"), "user_id", "ts", "event_id") for c in ("event_type", "event_id"))
    return e.withColumn("kind", kind).withColumn("source_id", at).where("event_type = 'purchase' AND kind = 'signup'").select("event_id", "user_id", "source_id")


def escalation(spark: SparkSession, d: str) -> DataFrame:
    """every sink is reported, one level higher where taint reaches it."""
    e = table(spark, d, "events")
    kind = flow.last_before(F.col("event_type"), F.col("event_type").isin("signup", "error"), "user_id", "ts", "event_id")
    level = F.when(F.col("kind") == "signup", "high").otherwise("medium")
    return e.withColumn("kind", kind).where("event_type = 'purchase'").select("event_id", level.alias("severity"))


def dedup_best(spark: SparkSession, d: str) -> DataFrame:
    """Of the findings at one place the most severe, then the first."""
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return findings.best(o, ["o_custkey", "o_orderstatus"], [F.col("o_orderpriority"), F.col("day"), F.col("o_orderkey")]).select("o_custkey", "o_orderstatus", "o_orderkey", "o_orderpriority")


def by_severity(spark: SparkSession, d: str) -> DataFrame:
    """A4: findings by severity in one row."""
    p = F.substring("o_orderpriority", 1, 1)
    return table(spark, d, "orders").agg(*[F.count(F.when(p.isin(*v), 1)).alias(n) for n, v in (("high", "12"), ("medium", "3"), ("low", "45"))])


def by_topdir(spark: SparkSession, d: str) -> DataFrame:
    """A5: findings by first path component."""
    top = F.regexp_extract("url", "^[a-z]+://[^/]*/([^/?#]*)", 1)
    return table(spark, d, "pages").groupBy(top.alias("dir")).agg(F.count("*").alias("findings"))


def pattern_match(spark: SparkSession, d: str) -> DataFrame:
    """Callee patterns; a part's type is the qualified name."""
    p = table(spark, d, "part").select("p_partkey", F.lower(F.regexp_replace("p_type", " ", ".")).alias("callee"))
    last = p.where(F.col("callee").contains(".")).select(F.concat(F.lit("*."), F.element_at(F.split("callee", "\\."), -1)).alias("pattern"))
    return relations.pattern_matches(p, last.union(p.select("callee")).distinct()).select("p_partkey", "callee", "pattern").distinct()


def tiers(spark: SparkSession, d: str) -> DataFrame:
    """A customer's supplier: of the own nation, else of the own region; none if more than three."""
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    # the candidates depend on the nation alone: at most four of a tier are kept there before customers are joined
    first = s.withColumn("i", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))).where("i <= 4").drop("i")
    region = n.select(F.col("n_nationkey").alias("other"), "n_regionkey")
    found = n.join(region, "n_regionkey").join(first, F.col("other") == F.col("s_nationkey"))
    found = found.withColumn("tier", F.when(F.col("n_nationkey") == F.col("s_nationkey"), 1).otherwise(2))
    by_nation = relations.first_of_tiers(found, ["n_nationkey"], "tier", "s_suppkey", 3)
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return c.join(by_nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "tier", "s_suppkey")


def division(spark: SparkSession, d: str) -> DataFrame:
    """Customers with orders of every priority."""
    o = table(spark, d, "orders")
    return relations.covers_all(o, "o_custkey", "o_orderpriority", o)


def agreement(spark: SparkSession, d: str) -> DataFrame:
    """The status that all orders of a customer agree on."""
    return relations.agreed(table(spark, d, "orders"), "o_custkey", "o_orderstatus")


def capped(spark: SparkSession, d: str) -> DataFrame:
    """Six causes a value at most, the smallest."""
    return relations.smallest(table(spark, d, "events"), "user_id", "event_id", 6, "causes")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "code"))


def secrets(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a literal secret."""
    return _lines(spark, d).where(F.col("code").rlike(_TOKEN)).select("doc_id", (F.col("line") + 1).alias("line"))


def suppressed(spark: SparkSession, d: str) -> DataFrame:
    """Lines under a marker on the same line or the line before."""
    code = F.split("text", "\n")
    near = lambda i: (F.try_element_at(code, i + 1).contains("icense")) | F.coalesce((i > 0) & F.try_element_at(code, F.when(i > 0, i)).contains("icense"), F.lit(False))
    hit = F.filter(F.transform(code, lambda _, i: F.when(near(i), i + 1)), lambda i: i.isNotNull())
    return table(spark, d, "documents").where(F.col("text").contains("icense")).select("doc_id", F.explode(hit).alias("line"))


def ids(spark: SparkSession, d: str) -> DataFrame:
    """Stable ids of findings, repeats numbered."""
    o = table(spark, d, "orders")
    return findings.numbered_ids(o, [F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey").cast("string")], ["o_orderkey"]).select("o_orderkey", "finding_id")


def history(spark: SparkSession, d: str) -> DataFrame:
    """Findings of two runs: new, open or fixed."""
    o = table(spark, d, "orders")
    return findings.recorded(o.where("o_orderstatus != 'F'"), o.where("o_orderstatus != 'O'"), "o_custkey")


def digests(spark: SparkSession, d: str) -> DataFrame:
    """One digest of each file's rows."""
    return findings.digest(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderstatus")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return code.taint_interproc(spark, folder)


_LAST = "last_value(CASE WHEN event_type IN ('signup', 'error') THEN {} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_CALLS = "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey"
_TEXT = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS code, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "call_edges_sites": (call_edges, "SELECT l_suppkey, l_partkey, count(*) AS sites, min(l_linenumber) AS first_line, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS lines FROM lineitem GROUP BY l_suppkey, l_partkey"),
    "callers": (callers, f"SELECT DISTINCT s_name AS caller, p_name AS callee {_CALLS} WHERE contains(p_name, 'e')"),
    "callees": (callees, f"SELECT DISTINCT s_name AS caller, p_name AS callee {_CALLS} WHERE contains(s_name, '7')"),
    "external_calls": (external_calls, "SELECT l_partkey, count(*) AS calls FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 25) GROUP BY l_partkey"),
    "most_depended_on": (most_depended_on, "SELECT n_name, count(*) AS users FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY users DESC, n_name LIMIT 5"),
    "dep_collapse_dir": (dep_collapse, "SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS calls FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY ALL"),
    "stmt_edges": (stmt_edges, "SELECT conv_id, src, dst, role FROM (SELECT conv_id, turn AS src, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst, role FROM conversations) WHERE dst IS NOT NULL"),
    "reaching_defs_straight": (reaching, f"SELECT event_id, user_id, def_id FROM (SELECT *, {_LAST.format('event_id')} AS def_id FROM events) WHERE event_type = 'purchase' AND def_id IS NOT NULL"),
    "taint_straight": (taint, f"SELECT event_id, user_id, source_id FROM (SELECT *, {_LAST.format('event_type')} AS kind, {_LAST.format('event_id')} AS source_id FROM events) WHERE event_type = 'purchase' AND kind = 'signup'"),
    "taint_escalation": (escalation, f"SELECT event_id, CASE WHEN kind = 'signup' THEN 'high' ELSE 'medium' END AS severity FROM (SELECT *, {_LAST.format('event_type')} AS kind FROM events) WHERE event_type = 'purchase'"),
    "findings_dedup_best": (dedup_best, "SELECT o_custkey, o_orderstatus, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderpriority, CAST(o_orderdate AS DATE), o_orderkey) = 1"),
    "findings_by_severity": (by_severity, "SELECT count(*) FILTER (left(o_orderpriority, 1) IN ('1', '2')) AS high, count(*) FILTER (left(o_orderpriority, 1) = '3') AS medium, count(*) FILTER (left(o_orderpriority, 1) IN ('4', '5')) AS low FROM orders"),
    "findings_by_topdir": (by_topdir, "SELECT regexp_extract(url, '^[a-z]+://[^/]*/([^/?#]*)', 1) AS dir, count(*) AS findings FROM pages GROUP BY 1"),
    "pattern_match_suffix": (pattern_match, "WITH p AS (SELECT p_partkey, lower(replace(p_type, ' ', '.')) AS callee FROM part), m AS (SELECT DISTINCT string_split(callee, '.')[-1] AS m FROM p WHERE contains(callee, '.')), w AS (SELECT DISTINCT callee AS w FROM p) SELECT p_partkey, callee, '*.' || m AS pattern FROM p JOIN m ON contains(callee, '.') AND string_split(callee, '.')[-1] = m UNION SELECT p_partkey, callee, w FROM p JOIN w ON callee = w OR (contains(w, '.') AND ends_with(callee, '.' || w))"),
    "resolve_priority": (tiers, "WITH f AS (SELECT c_custkey, s_suppkey, CASE WHEN c_nationkey = s_nationkey THEN 1 ELSE 2 END AS tier FROM customer JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON a.n_regionkey = b.n_regionkey JOIN supplier ON s_nationkey = b.n_nationkey), g AS (SELECT * FROM f QUALIFY tier = min(tier) OVER (PARTITION BY c_custkey)) SELECT c_custkey, tier, s_suppkey FROM g QUALIFY count(*) OVER (PARTITION BY c_custkey) <= 3"),
    "interface_division": (division, "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)"),
    "agreement_value": (agreement, "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN max(o_orderstatus) END AS agreed FROM orders GROUP BY o_custkey"),
    "capped_causes": (capped, "SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS causes FROM (SELECT DISTINCT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 6) GROUP BY user_id"),
    "secret_lines": (secrets, f"SELECT doc_id, CAST(line AS INTEGER) AS line FROM {_TEXT} WHERE regexp_matches(code, '{_TOKEN}')"),
    "suppressed_lines": (suppressed, f"WITH l AS {_TEXT} SELECT doc_id, CAST(line AS INTEGER) AS line FROM l WHERE EXISTS (SELECT 1 FROM l m WHERE m.doc_id = l.doc_id AND contains(m.code, 'icense') AND l.line - m.line IN (0, 1))"),
    "finding_ids": (ids, "SELECT o_orderkey, CASE WHEN n = 1 THEN b ELSE b || '-' || n END AS finding_id FROM (SELECT o_orderkey, b, row_number() OVER (PARTITION BY b ORDER BY o_orderkey) AS n FROM (SELECT o_orderkey, md5(concat_ws(chr(1), o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR))) AS b FROM orders))"),
    "history_upsert": (history, "SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN b.o_custkey IS NULL THEN 'fixed' WHEN a.o_custkey IS NULL THEN 'new' ELSE 'open' END AS status FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus <> 'F') a FULL JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus <> 'O') b ON a.o_custkey = b.o_custkey"),
    "graph_digest": (digests, "SELECT o_custkey, md5(string_agg(h, '' ORDER BY h)) AS digest FROM (SELECT o_custkey, md5(o_orderkey || '|' || o_orderstatus) AS h FROM orders) GROUP BY o_custkey"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for name, (q, _) in {**_QUERIES, **life.QUERIES, **code.QUERIES}.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in {**_QUERIES, **life.QUERIES, **code.QUERIES}.items()}
