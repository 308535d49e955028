"""Formats of results. Every row is put together by Spark; one document, where a format wants one, is
joined from a bounded report (findings, a bill of materials). Graphs are written as ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import escaped

_LEVEL = {"high": "error", "medium": "warning", "low": "note"}


def ordered(findings: DataFrame) -> DataFrame:
    """O1: findings by file, line, column, rule."""
    return findings.orderBy("file", "line", "col", "rule")


def text_lines(findings: DataFrame) -> DataFrame:
    """A line a finding."""
    where = F.concat_ws(":", "file", F.col("line").cast("string"), F.col("col").cast("string"))
    origin = F.when(F.col("origin").isNotNull(), F.concat(F.lit(" <- "), "origin")).otherwise("")
    return ordered(findings).select(F.concat(where, F.lit(" ["), "severity", F.lit("] "), "rule", F.lit(": "), "message", origin).alias("line"))


def json_lines(df: DataFrame) -> DataFrame:
    """A JSON object a row, nulls left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def _collected(items: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col("file"), F.col("line"), F.col("col"), F.col("rule"), items.alias("item")))), lambda x: x["item"])


def sarif(findings: DataFrame, tool: str = "loomline") -> DataFrame:
    """One SARIF 2.1.0 document: all rules, a result a finding with level and partial fingerprint;
    findings with a ``status`` other than open are suppressed outside the code."""
    level = F.coalesce(*[F.when(F.col("severity") == s, v) for s, v in _LEVEL.items()])
    region = F.struct(F.col("line").alias("startLine"), F.col("col").alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    quiet = F.when(F.col("status") != "open", F.array(F.struct(F.lit("external").alias("kind"), F.col("status").alias("justification")))) if "status" in findings.columns else F.lit(None)
    print_ = F.sha2(F.concat_ws("\u0001", "rule", "message", "file", "function"), 256)
    result = F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(print_.alias("primary/v1")).alias("partialFingerprints"), quiet.cast("array<struct<kind:string,justification:string>>").alias("suppressions"))
    body = findings.agg(_collected(result).alias("results"), F.array_sort(F.collect_set(F.struct(F.col("rule").alias("id")))).alias("rules"))
    driver = F.struct(F.struct(F.lit(tool).alias("name"), F.col("rules")).alias("driver"))
    document = F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(F.struct(driver.alias("tool"), F.col("results"))).alias("runs"))
    return body.select(F.to_json(document).alias("json"))


def crypto_findings(uses: DataFrame) -> DataFrame:
    """Uses as findings: one for each issue, of the rule it belongs to."""
    issue = F.explode(F.split("issue", "; ")).alias("message")
    rows = uses.where("issue IS NOT NULL").select("file", "line", F.lit(1).alias("col"), F.coalesce("name", F.lit("")).alias("function"), issue)
    rule = F.when(F.col("message").contains("private"), "crypto-private-key").when(F.col("message").contains("bits"), "crypto-key-size").when(F.col("message").contains("certificates"), "crypto-tls-verify").otherwise("crypto-weak")
    return rows.withColumn("rule", rule).withColumn("severity", F.when(rule.isin("crypto-private-key", "crypto-tls-verify"), "high").otherwise("medium")).withColumn("origin", F.lit(None).cast("string"))


def bill(materials: DataFrame) -> DataFrame:
    """A CycloneDX 1.6 document of grouped uses (name, algorithm, uses, first)."""
    part = F.struct(F.lit("cryptographic-asset").alias("type"), F.coalesce("algorithm", "name").alias("name"), F.struct(F.struct(F.col("first").alias("location")).alias("occurrence"), F.col("uses")).alias("evidence"))
    body = materials.agg(F.transform(F.array_sort(F.collect_list(F.struct("name", "algorithm", part.alias("part")))), lambda x: x["part"]).alias("components"))
    return body.select(F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.6").alias("specVersion"), F.lit(1).alias("version"), "components")).alias("json"))


def dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a DOT graph in order: clusters by file, nodes, edges coloured by kind."""
    q = lambda c: F.concat(F.lit('"'), escaped(F.col(c), "dot"), F.lit('"'))
    colour = F.when(F.col("kind") == "true", "green").when(F.col("kind") == "false", "red").when(F.col("kind").isin("back", "call"), "blue").otherwise("black")
    n = nodes.select(F.lit(1).alias("part"), F.col("file").alias("a"), F.col("id").alias("b"), F.concat(F.lit("    "), q("id"), F.lit(" [label="), q("name"), F.lit("];")).alias("line"))
    opens = nodes.select("file").distinct().select(F.lit(1).alias("part"), F.col("file").alias("a"), F.lit("").alias("b"), F.concat(F.lit("  subgraph "), F.concat(F.lit('"cluster_'), escaped(F.col("file"), "dot"), F.lit('"')), F.lit(" {")).alias("line"))
    closes = nodes.select("file").distinct().select(F.lit(1).alias("part"), F.col("file").alias("a"), F.lit("￿").alias("b"), F.lit("  }").alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), F.concat(F.lit("  "), q("src"), F.lit(" -> "), q("dst"), F.lit(" [color="), colour, F.lit("];")).alias("line"))
    ends = nodes.sparkSession.createDataFrame([(0, "", "", "digraph g {"), (3, "", "", "}")], "part int, a string, b string, line string")
    return ends.unionByName(opens).unionByName(n).unionByName(closes).unionByName(e).orderBy("part", "a", "b", "line").select("line")


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of GraphML with stable ids, nodes (id, kind, name) before edges (src, dst, kind)."""
    x = lambda c: escaped(F.coalesce(F.col(c), F.lit("")), "xml")
    n = nodes.select(F.lit(1).alias("part"), F.col("id").alias("a"), F.lit("").alias("b"), F.concat(F.lit('<node id="'), x("id"), F.lit('"><data key="kind">'), x("kind"), F.lit('</data><data key="name">'), x("name"), F.lit("</data></node>")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), F.concat(F.lit('<edge source="'), x("src"), F.lit('" target="'), x("dst"), F.lit('"><data key="kind">'), x("kind"), F.lit("</data></edge>")).alias("line"))
    head = '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">'
    ends = nodes.sparkSession.createDataFrame([(0, "", "", head), (3, "", "", "</graph></graphml>")], "part int, a string, b string, line string")
    return ends.unionByName(n).unionByName(e).orderBy("part", "a", "b", "line").select("line")


def _camel(kind: Column) -> Column:
    return F.replace(F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))


def neo4j_nodes(nodes: DataFrame) -> DataFrame:
    """CSV lines of nodes, after a header; a field is quoted only where it must be."""
    line = F.concat_ws(",", escaped(F.col("id"), "csv"), F.concat(F.lit("Node;"), _camel(F.col("kind"))), escaped(F.coalesce("name", F.lit("")), "csv"))
    head = nodes.sparkSession.createDataFrame([("", "id:ID,:LABEL,name")], "k string, line string")
    return head.unionByName(nodes.select(F.concat(F.lit("1"), "id").alias("k"), line.alias("line"))).orderBy("k").select("line")


def neo4j_edges(edges: DataFrame) -> DataFrame:
    """CSV lines of edges, after a header."""
    line = F.concat_ws(",", escaped(F.col("src"), "csv"), escaped(F.col("dst"), "csv"), F.upper("kind"))
    head = edges.sparkSession.createDataFrame([("", "", ":START_ID,:END_ID,:TYPE")], "k string, d string, line string")
    return head.unionByName(edges.select(F.concat(F.lit("1"), "src").alias("k"), F.col("dst").alias("d"), line.alias("line"))).orderBy("k", "d").select("line")


def by_kind(rows: DataFrame) -> DataFrame:
    """How many nodes or edges there are of each kind."""
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


def of_functions(edges: DataFrame, owners: DataFrame, text: str, kinds: list[str]) -> DataFrame:
    """Edges of ``kinds`` both of whose ends lie in functions whose name contains ``text`` (owners: id, function)."""
    own = owners.where(F.col("function").contains(text)).select("id").distinct()
    e = edges.where(F.col("kind").isin(kinds))
    return e.join(own.withColumnRenamed("id", "src"), "src", "left_semi").join(own.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)
