"""Findings over time: filters, suppressions, baselines, history, triage, run cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions.text import date_after, finding_key, matches_wildcard, severity_rank

MARK = "loomline-ignore"
ORDER = ("file", "line", "col", "rule")


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    """P10: findings of ``severity`` or more."""
    return findings.where(severity_rank(F.col("severity")) >= severity_rank(F.lit(severity)))


def configured(findings: DataFrame, scopes: DataFrame) -> DataFrame:
    """Findings under configuration rows (folder, disable, exclude, rule, severity).

    A row holds for files below its folder (empty: all). A disabled rule and an excluded path are
    left out; the deepest folder's severity for a rule counts. The table is small and broadcast.
    """
    s = F.broadcast(scopes)
    below = (F.col("folder") == "") | F.col("file").startswith(F.concat("folder", F.lit("/")))
    out = (below & (F.col("disable") == F.col("f.rule"))) | (below & matches_wildcard(F.col("file"), F.col("exclude")) & (F.col("s.rule").isNull() | (F.col("s.rule") == F.col("f.rule"))))
    left = findings.alias("f").join(s.alias("s"), out, "left_anti")
    how = s.where("severity IS NOT NULL AND exclude IS NULL").select("folder", F.col("rule").alias("own_rule"), F.col("severity").alias("own_severity"))
    joined = left.withColumn("_id", F.monotonically_increasing_id()).join(how, (F.col("own_rule") == F.col("rule")) & below, "left")
    picked = joined.groupBy("_id", *left.columns).agg(F.max_by("own_severity", F.length("folder")).alias("own_severity"))
    return picked.withColumn("severity", F.coalesce("own_severity", "severity")).select(*left.columns)


def suppressions(files: DataFrame, mark: str = MARK) -> DataFrame:
    """``file``, ``line`` (null: the whole file), ``rules`` (null: all) and ``until`` of the marks in ``files`` (path, text).

    ``# mark`` holds for its own line and, where the line is a comment alone, for the next;
    ``mark-file`` for the file; ``mark: a, b`` for these rules; ``until=2030-01-31`` up to that day.
    A date that is none is no end. Lines are taken from the array of a text: nothing is shuffled.
    """
    lines = F.transform(F.split("text", "\n"), lambda code, i: F.struct((i + 1).alias("line"), code.alias("code")))
    own = files.select(F.col("path").alias("file"), F.explode(F.filter(lines, lambda x: x["code"].contains(mark))).alias("m")).select("file", "m.line", "m.code")
    code = F.col("code")
    after = F.regexp_extract(code, mark + r"(?:-file)?\s*:\s*([A-Za-z0-9_, -]*?)\s*(?:until=|$|\*/|-->)", 1)
    rules = F.when(after != "", F.transform(F.split(after, r"\s*,\s*"), F.trim))
    until = F.regexp_extract(code, r"until=(\d{4}-\d{2}-\d{2})", 1)
    alone = code.rlike(r"^\s*(#|//|/\*|\*|--|<!--)")
    reach = F.when(code.contains(mark + "-file"), F.array(F.lit(None).cast("int"))).when(alone, F.array("line", F.col("line") + 1)).otherwise(F.array("line"))
    return own.select("file", F.explode(reach).alias("line"), rules.alias("rules"), F.when(until != "", until).alias("until"))


def judged(findings: DataFrame, marks: DataFrame, today: str) -> DataFrame:
    """Findings with ``verdict``: suppressed, expired (a mark's day is past) or reported."""
    m = marks.select(F.col("file").alias("at_file"), F.col("line").alias("at_line"), "rules", "until")
    hit = (F.col("file") == F.col("at_file")) & (F.col("at_line").isNull() | (F.col("at_line") == F.col("line"))) & (F.col("rules").isNull() | F.array_contains("rules", F.col("rule")))
    rows = findings.withColumn("_id", F.monotonically_increasing_id())
    past = date_after(F.col("until"), F.lit(today))
    verdict = rows.join(m, hit).groupBy("_id").agg(F.min(past.cast("int")).alias("past"))
    return rows.join(verdict, "_id", "left").withColumn("verdict", F.when(F.col("past") == 0, "suppressed").when(F.col("past") == 1, "expired").otherwise("reported")).drop("_id", "past")


def baseline(findings: DataFrame, review_by: str | None = None) -> DataFrame:
    """How many findings there are of each rule, file, function, message and fingerprint."""
    by = ["rule", "file", "function", "message", "fingerprint"]
    return findings.groupBy(*by).agg(F.count("*").alias("count")).withColumn("review_by", F.lit(review_by).cast("string"))


def new_findings(findings: DataFrame, base: DataFrame, today: str) -> DataFrame:
    """Findings that no baseline entry takes up, with ``tier`` null; others have the tier that did.

    Five tiers, each over what is left: all and the fingerprint; all; same file (function renamed); same
    function (file moved); rule, message and fingerprint. An entry takes as many findings as it
    counts, in order of place; one whose review day is past takes none.
    """
    tiers = [["rule", "file", "function", "message", "fingerprint"], ["rule", "file", "function", "message"], ["rule", "file", "message", "fingerprint"], ["rule", "function", "message", "fingerprint"], ["rule", "message", "fingerprint"]]
    left = findings.withColumn("_id", F.monotonically_increasing_id()).withColumn("tier", F.lit(None).cast("int"))
    slots = base.where(~date_after(F.col("review_by"), F.lit(today))).select("rule", "file", "function", "message", "fingerprint", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("slot"))
    slots = slots.withColumn("_slot", F.monotonically_increasing_id())
    done = None
    for n, keys in enumerate(tiers, 1):
        a = left.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("file", "line", "col", "_id")))
        b = slots.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("file", "function", "slot", "_slot"))).select(*keys, "_n", "_slot")
        b = b.toDF(*[f"b_{c}" for c in b.columns])
        same = F.lit(True)
        for c in [*keys, "_n"]:
            same = same & F.col(c).eqNullSafe(F.col(f"b_{c}"))
        both = a.join(b, same, "left")
        taken = both.where("b__slot IS NOT NULL").withColumn("tier", F.lit(n))
        slots = slots.join(taken.select(F.col("b__slot").alias("_slot")), "_slot", "left_anti")
        part = taken.select(*findings.columns, "tier")
        done = part if done is None else done.unionByName(part)
        left = both.where("b__slot IS NULL").select(*left.columns)
    return done.unionByName(left.select(*findings.columns, "tier"))


def recorded(history: DataFrame, findings: DataFrame, run: int) -> DataFrame:
    """History (id, rule, message, file, line, first_seen, last_seen, seen_run, status, reason) after a run.

    New findings are open; one that is absent is fixed, but for those that were triaged; one that
    returns after an absence is open again and loses its reason.
    """
    now = findings.select("id", F.struct("rule", "message", "file", "line").alias("now"))
    both = history.withColumn("known", F.lit(True)).join(now, "id", "full")
    here, known = F.col("now").isNotNull(), F.col("known").isNotNull()
    returned = here & known & (F.col("seen_run") < run - 1)
    status = F.when(~known | returned, "open").when(~here & (F.col("status") == "open"), "fixed").when(here & (F.col("status") == "fixed"), "open").otherwise(F.col("status"))
    pick = lambda c: F.coalesce(F.col(f"now.{c}"), F.col(c)).alias(c)
    return both.select(
        "id", pick("rule"), pick("message"), pick("file"), pick("line"), F.coalesce("first_seen", F.lit(run)).alias("first_seen"), F.when(here, F.lit(run)).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(here, F.lit(run)).otherwise(F.col("seen_run")).alias("seen_run"), status.alias("status"), F.when(returned | ~known, F.lit(None)).otherwise(F.col("reason")).alias("reason"),
    )


def triaged(history: DataFrame, status: str, reason: str | None = None, ids: list[str] | None = None, rule: str | None = None, path: str | None = None) -> DataFrame:
    """History with ``status`` set where all given selectors hold: ids, rule, part of the path."""
    if ids is None and rule is None and path is None:
        raise ValueError("a selector is needed: ids, rule or path")
    chosen = F.lit(True)
    if ids is not None:
        chosen = chosen & F.col("id").isin(ids)
    if rule is not None:
        chosen = chosen & (F.col("rule") == rule)
    if path is not None:
        chosen = chosen & F.col("file").contains(path)
    return history.withColumn("status", F.when(chosen, status).otherwise(F.col("status"))).withColumn("reason", F.when(chosen, F.lit(reason)).otherwise(F.col("reason")))


def listed(history: DataFrame, run: int, everything: bool = False) -> DataFrame:
    """Present findings; with ``everything`` absent ones too, shown as fixed, in order of place."""
    present = F.col("seen_run") == run
    out = history if everything else history.where(present)
    return out.withColumn("shown", F.when(present, F.col("status")).otherwise(F.concat("status", F.lit(" (fixed)")))).orderBy("file", "line")


def by_rule(history: DataFrame, run: int) -> DataFrame:
    """A5: open and present findings by rule."""
    return history.where((F.col("status") == "open") & (F.col("seen_run") == run)).groupBy("rule").agg(F.count("*").alias("findings"))


def by_first_folder(history: DataFrame, run: int) -> DataFrame:
    """A5: open and present findings by first path component: ``.`` for a bare file, empty for an absolute path."""
    top = F.when(~F.col("file").contains("/"), ".").otherwise(F.element_at(F.split("file", "/"), 1))
    return history.where((F.col("status") == "open") & (F.col("seen_run") == run)).groupBy(top.alias("dir")).agg(F.count("*").alias("findings"))


def with_ids(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """``id`` of each finding, from rule, message and its source line (``lines``: file, line, code), -2, -3 ... for repeats."""
    known = findings.join(lines, ["file", "line"], "left")
    base = finding_key(F.col("rule"), F.col("message"), F.coalesce("code", F.concat_ws("\u0001", "file", "function")))
    n = F.row_number().over(Window.partitionBy("_base").orderBy(*ORDER))
    out = known.withColumn("_base", base).withColumn("_n", n)
    return out.withColumn("id", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", F.col("_n").cast("string")))).select(*findings.columns, "id")


def all_findings(*parts: DataFrame) -> DataFrame:
    """One table of several scans' findings, without repeats of a place, rule and function."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.dropDuplicates(["file", "line", "col", "rule", "function"])


def reusable(cache: DataFrame, inputs: DataFrame, project: str) -> DataFrame:
    """Cached results (project, inputs as map of path to key, result) whose recorded inputs are unchanged."""
    now = F.broadcast(inputs.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", "key")))).alias("now")))
    entries = lambda c: F.array_sort(F.map_entries(c))
    return cache.where(F.col("project") == project).crossJoin(now).where(entries("inputs") == entries("now")).select("project", "result")


def pruned(cache: DataFrame, run: int, keep: int = 30) -> DataFrame:
    """What was used in one of the last ``keep`` runs."""
    return cache.where(F.col("used_run") > run - keep)


def cache_status(cache: DataFrame) -> DataFrame:
    """Entries and bytes of each kind."""
    return cache.groupBy("kind").agg(F.count("*").alias("entries"), F.sum(F.octet_length("data")).alias("bytes"))


def current(cache: DataFrame, stamp: str) -> DataFrame:
    """Derived rows of the present version; those of any other are dropped, histories are kept apart."""
    return cache.where(F.col("stamp") == stamp)


def exit_code(findings: DataFrame, errors: Column | int = 0) -> DataFrame:
    """2 where files failed, else 1 where there are findings, else 0."""
    return findings.agg(F.when(F.lit(errors) > 0, 2).when(F.count("*") > 0, 1).otherwise(0).alias("code"))
