"""Name resolution as joins: who calls whom, which file imports which.

Names are joined by value on exploded suffixes, never by pattern on two columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.operators.relations import suffixes

#: More targets than so many are no answer.
MOST = 3
CONSTRUCTORS = ("__init__", "constructor", "initialize", "__construct", "init")


def last_segment(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def expanded(sites: DataFrame, imports: DataFrame) -> DataFrame:
    """``callee`` with an imported head written out (``rc`` to ``util.run_cmd``); ``written`` keeps it as it was.

    ``sites`` has path and callee, ``imports`` path, names and full.
    """
    bound = imports.select("path", F.explode(F.arrays_zip("names", "full")).alias("b")).select("path", F.col("b.names").alias("head"), F.col("b.full").alias("full"))
    bound = bound.where("head != '*'").groupBy("path", "head").agg(F.max("full").alias("full"))
    head = F.element_at(F.split("callee", r"\."), 1)
    out = sites.withColumn("head", head).join(bound, ["path", "head"], "left").withColumn("written", F.col("callee"))
    rest = F.expr("substring(callee, length(head) + 1)")
    return out.withColumn("callee", F.when(F.col("full").isNotNull(), F.concat("full", rest)).otherwise(F.col("callee"))).drop("head", "full")


def imported_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``src_file``, ``dst_file``, ``module``, ``line`` of the imports that a file of ``files`` (path) answers.

    A module's dotted path, also with each imported name behind it, must end a file's stem (or
    its folder with ``__init__``); leading dots start at the importing file's folder. Of several
    files those with the most leading folders in common count, three at most.
    """
    names = F.concat(F.array(F.lit("")), F.transform("full", lambda f: F.concat(F.lit("."), last_segment(f))))
    asked = imports.select("path", "module", "line", F.explode(F.array_distinct(names)).alias("name"))
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    bare = F.regexp_replace("module", r"^\.+", "")
    parts = F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/")
    folder = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - dots + 1, F.lit(0))), "/")
    want = F.regexp_replace(F.regexp_replace(F.concat(bare, "name"), r"^\.+", ""), r"\.", "/")
    full = F.when(dots > 0, F.regexp_replace(F.concat_ws("/", folder, F.when(want != "", want)), "^/", ""))
    asked = asked.select("path", "module", "line", want.alias("want"), full.alias("full")).where("want != '' OR full != ''")
    stem = F.regexp_replace(F.regexp_replace("path", r"\.[^./]+$", ""), "/__init__$", "")
    named = files.select("path", stem.alias("stem"))
    steps = F.split("stem", "/")
    tails = named.select(F.col("path").alias("dst_file"), F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, i, F.size(steps)), "/"))).alias("want"))
    absolute = asked.where("full IS NULL").join(tails, "want")
    relative = asked.where("full IS NOT NULL").drop("want").join(named.select(F.col("path").alias("dst_file"), F.col("stem").alias("full")), "full")
    found = absolute.select("path", "module", "line", "dst_file").union(relative.select("path", "module", "line", "dst_file")).where("path != dst_file").distinct()
    return nearest(found, "path", "dst_file", ["path", "module", "line"]).select(F.col("path").alias("src_file"), "dst_file", "module", "line")


def nearest(found: DataFrame, own: str, other: str, by: list[str], most: int = MOST) -> DataFrame:
    """Of each group the rows whose two files share the most leading folders, ties kept, none of more than ``most``."""
    a, b = (F.split(F.regexp_replace(c, "/?[^/]*$", ""), "/") for c in (own, other))
    shared = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda i: F.slice(a, 1, i) == F.slice(b, 1, i)))
    w = Window.partitionBy(*by)
    near = found.withColumn("_shared", shared).withColumn("_most", F.max("_shared").over(w)).where("_shared = _most")
    return near.withColumn("_n", F.count("*").over(w)).where(F.col("_n") <= most).drop("_shared", "_most", "_n")


def visible_files(dependencies: DataFrame) -> DataFrame:
    """``path`` and ``seen`` of other files a file sees: its imports and their imports."""
    one = dependencies.select(F.col("src_file").alias("path"), F.col("dst_file").alias("seen")).distinct()
    two = one.join(one.select(F.col("path").alias("seen"), F.col("seen").alias("far")), "seen").select("path", F.col("far").alias("seen"))
    return one.union(two).where("path != seen").distinct()


def resolved(sites: DataFrame, functions: DataFrame, visible: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """``fn_id``, ``line``, ``col``, ``target``, ``tier`` and ``exact`` of the call sites (fn_id, path, callee, line, col).

    Tiers: 1 the callee is the function's qualified name or a dotted suffix of it; 2 a suffix of the
    callee is a whole name, the longest; 3 a constructor of the class called; 4 only the last segments
    agree (a guess). The first tier with a candidate counts; of its candidates those in the same
    file, else in files that are seen, else all; more than three are none.
    """
    known = functions.where("name != '<module>'").select(F.col("fn_id").alias("target"), F.col("path").alias("target_path"), "name")
    keys = ["fn_id", "path", "callee", "line", "col"]
    own = sites.select(*keys).where("callee != ''")
    first = known.select("target", "target_path", F.explode(suffixes(F.col("name"))).alias("callee"))
    tier1 = own.join(first, "callee").select(*keys, "target", "target_path", F.lit(1).alias("tier"), F.lit(0).alias("cut"))
    cut = own.select(*keys, F.posexplode(suffixes(F.col("callee"))).alias("cut", "name")).where("cut > 0")
    tier2 = cut.join(known, "name").select(*keys, "target", "target_path", F.lit(2).alias("tier"), "cut")
    made = known.where(last_segment(F.col("name")).isin(*CONSTRUCTORS)).withColumn("class", F.regexp_replace("name", r"\.[^.]+$", ""))
    made = made.select("target", "target_path", F.explode(suffixes(F.col("class"))).alias("callee"))
    called = F.when(last_segment(F.col("callee")) == "new", F.regexp_replace("callee", r"\.[^.]+$", "")).otherwise(F.col("callee"))
    built = own.select(*keys, F.posexplode(suffixes(called)).alias("cut", "class"))
    tier3 = built.join(made.withColumnRenamed("callee", "class"), "class").select(*keys, "target", "target_path", F.lit(3).alias("tier"), "cut")
    guess = known.where(F.col("name").contains(".")).withColumn("last", last_segment(F.col("name"))).drop("name")
    tier4 = own.where(F.col("callee").contains(".")).withColumn("last", last_segment(F.col("callee"))).join(guess, "last").select(*keys, "target", "target_path", F.lit(4).alias("tier"), F.lit(0).alias("cut"))
    found = tier1.union(tier2).union(tier3).union(tier4).join(visible.select("path", F.col("seen").alias("target_path"), F.lit(1).alias("is_seen")), ["path", "target_path"], "left")
    where = F.when(F.col("path") == F.col("target_path"), 0).when(F.col("is_seen") == 1, 1).otherwise(2)
    w = Window.partitionBy(*keys)
    best = found.withColumn("rank", F.struct("tier", "cut", where.alias("where"))).withColumn("least", F.min("rank").over(w)).where("rank = least")
    best = best.withColumn("n", F.size(F.collect_set("target").over(w))).where(F.col("n") <= MOST)
    return best.select("fn_id", "line", "col", "callee", "target", "tier", (F.col("tier") < 4).alias("exact")).distinct()


def overrides(bases: DataFrame, functions: DataFrame) -> DataFrame:
    """``class``, ``method``, ``target`` and ``inherited``: the nearest definition up the bases
    (inherited) and all overrides further down. ``bases`` is the closure (low, high, depth)."""
    own = functions.where("owner IS NOT NULL").select(F.col("owner").alias("defined"), last_segment(F.col("name")).alias("method"), F.col("fn_id").alias("target"))
    self_ = own.select(F.col("defined").alias("class"), "method", "target", F.lit(0).alias("depth"))
    up = bases.join(own, bases.high == own.defined).select(F.col("low").alias("class"), "method", "target", "depth")
    w = Window.partitionBy("class", "method")
    near = self_.union(up).withColumn("least", F.min("depth").over(w)).where("depth = least").select("class", "method", "target", F.lit(True).alias("inherited"))
    down = bases.join(own, bases.low == own.defined).select(F.col("high").alias("class"), "method", "target", F.lit(False).alias("inherited"))
    has = near.select("class", "method").distinct()
    return near.union(down.join(has, ["class", "method"], "left_semi")).distinct()


def receiver_classes(functions: DataFrame, found: DataFrame, classes: DataFrame) -> DataFrame:
    """``fn_id``, ``var``, ``class`` of variables whose class is known: declared, ``self``, or made by
    a constructor that ``found`` resolves. A variable with two classes has none. ``classes`` has name."""
    declared = functions.select("fn_id", F.explode("types").alias("t")).select("fn_id", F.col("t.name").alias("var"), F.col("t.type").alias("class"))
    own = functions.where("receiver IS NOT NULL").select("fn_id", F.col("receiver").alias("var"), F.col("owner").alias("class"))
    block = functions.select("fn_id", F.explode("blocks").alias("b")).select("fn_id", F.explode("b.stmts").alias("s"))
    made = block.select("fn_id", F.explode("s.assigns").alias("a"), F.col("s.calls").alias("all")).where("size(a.calls) = 1 AND size(a.paths) = 0")
    made = made.select("fn_id", F.col("a.target").alias("var"), F.element_at("all", F.element_at("a.calls", 1) + 1).alias("c")).select("fn_id", "var", "c.line", "c.col")
    made = made.join(found.where("tier = 3"), ["fn_id", "line", "col"]).join(functions.select(F.col("fn_id").alias("target"), F.col("owner").alias("class")), "target").select("fn_id", "var", "class")
    every = declared.union(own).union(made).join(classes.select(F.col("name").alias("class")).distinct(), "class", "left_semi")
    return every.groupBy("fn_id", "var").agg(F.min("class").alias("class"), F.max("class").alias("other")).where("class = other").select("fn_id", "var", "class")


def methods_of_classes(sites: DataFrame, found: DataFrame, receivers: DataFrame, methods: DataFrame) -> DataFrame:
    """``found`` with the guesses replaced where the receiver's class is known.

    ``methods`` are :func:`overrides`; ``super()`` calls take the inherited ones alone. Tier 0, exact.
    """
    own = sites.withColumn("var", F.regexp_replace("callee", r"\.[^.]+$", "")).withColumn("method", last_segment(F.col("callee"))).where("var != callee")
    typed = own.join(receivers, ["fn_id", "var"]).join(methods, ["class", "method"]).where("var != 'super' OR inherited")
    typed = typed.select("fn_id", "line", "col", "callee", "target", F.lit(0).alias("tier"), F.lit(True).alias("exact")).distinct()
    left = found.join(typed.select("fn_id", "line", "col").distinct(), ["fn_id", "line", "col"], "left_anti")
    return left.unionByName(typed)


def callbacks(arguments: DataFrame, functions: DataFrame) -> DataFrame:
    """Arguments that name a function of the same file: fn_id, target, line, handed over and not called."""
    names = arguments.select("fn_id", F.element_at(F.split("fn_id", ":"), 1).alias("path"), "line", F.explode("paths").alias("name"))
    return names.join(functions.select("path", "name", F.col("fn_id").alias("target")), ["path", "name"]).select("fn_id", "target", "line").distinct()


def edges(sites: DataFrame) -> DataFrame:
    """A1: call edges of resolved sites: count, first line, sorted lines."""
    return sites.groupBy("fn_id", "target").agg(F.count("*").alias("sites"), F.min("line").alias("first_line"), F.sort_array(F.collect_set("line")).alias("lines"))


def external_calls(sites: DataFrame, found: DataFrame, top: int | None = None) -> DataFrame:
    """Callees that resolve to nothing, counted; the ``top`` most frequent if asked for."""
    left = sites.join(found.select("fn_id", "line", "col").distinct(), ["fn_id", "line", "col"], "left_anti").groupBy("callee").agg(F.count("*").alias("calls"))
    return left.orderBy(F.desc("calls"), "callee").limit(top) if top else left


def dependency_edges(imported: DataFrame, found: DataFrame, functions: DataFrame) -> DataFrame:
    """A3: file edges (src, dst): imports sorted, calls summed, the first three examples."""
    path = functions.select(F.col("fn_id"), "path")
    called = found.join(path, "fn_id").join(functions.select(F.col("fn_id").alias("target"), F.col("path").alias("dst"), F.col("name").alias("to")), "target")
    called = called.where("path != dst").groupBy(F.col("path").alias("src"), "dst").agg(F.count("*").alias("calls"), F.slice(F.array_sort(F.collect_set("to")), 1, 3).alias("examples"))
    through = imported.groupBy(F.col("src_file").alias("src"), F.col("dst_file").alias("dst")).agg(F.sort_array(F.collect_set("module")).alias("imports"))
    none = F.array().cast("array<string>")
    return through.join(called, ["src", "dst"], "full").select("src", "dst", F.coalesce("imports", none).alias("imports"), F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("examples", none).alias("examples"))


def bound_arguments(arguments: DataFrame, found: DataFrame, functions: DataFrame) -> DataFrame:
    """Arguments with the parameter of the target that takes them: keyword first, else by position."""
    params = functions.select(F.col("fn_id").alias("target"), F.posexplode("params").alias("at", "param"))
    own = arguments.join(found.where("exact").select("fn_id", "line", "col", "target"), ["fn_id", "line", "col"]).join(params, "target")
    named = F.when(F.col("kw").isNotNull(), F.col("kw") == F.col("param")).otherwise((F.col("pos") >= 0) & (F.col("pos") == F.col("at")))
    return own.where(named).select("fn_id", "line", "col", "ord", "kw", "target", "param", "at", "paths")
