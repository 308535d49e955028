"""Control and data flow inside functions with branches, over relations of statements and edges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.frontend import facts
from loomline.operators import graph
from loomline.sources.scratch import kept

#: The more specific kind counts where two ways lead from one statement to another.
_RANK = ["normal", "true", "false", "back", "break", "continue", "return", "exception"]


def _node(block: str, idx: str):
    return F.concat_ws(":", F.col(block).cast("string"), F.col(idx).cast("string"))


def statement_edges(functions: DataFrame) -> DataFrame:
    """``fn_id``, ``src``, ``dst``, ``kind`` between statements (``block:idx``; ``entry``, ``exit``).

    Empty blocks are skipped, the most specific of the kinds on the way kept.
    """
    rank = F.array_position(F.array(*[F.lit(k) for k in _RANK]), F.col("kind"))
    blocks = functions.select("fn_id", F.explode("blocks").alias("b")).select("fn_id", "b.block", F.size("b.stmts").alias("n"))
    blocks = kept(blocks)
    edges = kept(facts.flow_edges(functions).withColumn("rank", rank).select("fn_id", "src", "dst", "rank"))
    empty = blocks.where("n = 0 AND block NOT IN (0, 1)").select("fn_id", F.col("block").alias("dst"))
    done, left = None, edges
    for _ in range(graph.ROUNDS):
        at_empty = left.join(empty, ["fn_id", "dst"], "left_semi")
        through = left.join(empty, ["fn_id", "dst"], "left_anti")
        done = through if done is None else done.union(through)
        step = at_empty.alias("a").join(edges.alias("b"), (F.col("a.fn_id") == F.col("b.fn_id")) & (F.col("a.dst") == F.col("b.src")))
        left = kept(step.select("a.fn_id", "a.src", "b.dst", F.greatest("a.rank", "b.rank").alias("rank")).distinct())
        if left.isEmpty():
            break
    size = blocks.select("fn_id", F.col("block").alias("src"), F.col("n").alias("src_n"))
    to = blocks.select("fn_id", F.col("block").alias("dst"), F.col("n").alias("dst_n"))
    between = done.join(size, ["fn_id", "src"]).join(to, ["fn_id", "dst"]).where("src_n > 0 OR src = 0")
    first = F.when(F.col("dst") == 1, "exit").otherwise(F.concat(F.col("dst").cast("string"), F.lit(":0")))
    last = F.when(F.col("src_n") > 0, F.concat_ws(":", F.col("src").cast("string"), (F.col("src_n") - 1).cast("string"))).otherwise("entry")
    across = between.select("fn_id", last.alias("from"), first.alias("to"), "rank")
    begin = blocks.where("block = 0 AND n > 0").select("fn_id", F.lit("entry").alias("from"), F.lit("0:0").alias("to"), F.lit(1).cast("long").alias("rank"))
    s = F.explode(F.sequence(F.lit(1), F.col("n") - 1))
    inside = blocks.where("n > 1").select("fn_id", "block", s.alias("i"))
    inside = inside.select("fn_id", F.concat_ws(":", F.col("block").cast("string"), (F.col("i") - 1).cast("string")).alias("from"), F.concat_ws(":", F.col("block").cast("string"), F.col("i").cast("string")).alias("to"), F.lit(1).cast("long").alias("rank"))
    out = across.union(begin).union(inside).groupBy("fn_id", "from", "to").agg(F.max("rank").alias("rank"))
    kind = F.element_at(F.array(*[F.lit(k) for k in _RANK]), F.col("rank").cast("int"))
    return out.select("fn_id", F.col("from").alias("src"), F.col("to").alias("dst"), kind.alias("kind"))


def dead_code(functions: DataFrame) -> DataFrame:
    """a finding for each connected region of statements that nothing reaches: fn_id, path, line, last_line, statements."""
    node = lambda c: F.concat_ws("#", "fn_id", F.col(c).cast("string"))
    e = kept(facts.flow_edges(functions).select(node("src").alias("src"), node("dst").alias("dst"), "kind"))
    live = graph.reach(e, functions.select(F.concat(F.col("fn_id"), F.lit("#0")).alias("node"))).select("node")
    own = kept(facts.statements(functions).withColumn("node", node("block")))
    dead = own.join(live, "node", "left_anti")
    alive = own.join(live, "node", "left_semi").select("fn_id", "line", "col").distinct()
    dead = kept(dead.join(alive, ["fn_id", "line", "col"], "left_anti"))  # a copy of a live statement does not count
    nodes = dead.select("node").distinct()
    among = e.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
    region = graph.components(among)
    out = dead.join(region, "node", "left").withColumn("region", F.coalesce("component", "node"))
    return out.groupBy("fn_id", "path", "region").agg(F.min("line").alias("line"), F.max("line").alias("last_line"), F.countDistinct("line", "col").alias("statements")).drop("region")


def _dependence(edges: pd.DataFrame) -> pd.DataFrame:
    """Control dependence of one function's statement graph, by post-dominators."""
    pairs = list(zip(edges.src, edges.dst, strict=True))
    after: dict[str, set[str]] = {}
    before: dict[str, set[str]] = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
        before.setdefault(b, set()).add(a)
    ends, todo = {"exit"}, ["exit"]  # nodes that can reach the exit
    while todo:
        for a in before.get(todo.pop(), ()):
            if a not in ends:
                ends.add(a)
                todo.append(a)
    post = {n: ({n} if n == "exit" else set(ends)) for n in ends}
    changed = True
    while changed:
        changed = False
        for n in sorted(ends - {"exit"}):
            new = {n} | set.intersection(*[post[m] for m in after.get(n, ()) if m in ends])
            if new != post[n]:
                post[n] = new
                changed = True
    rows = []
    for a in sorted(ends):
        if len(after.get(a, ())) > 1:
            for b in after[a]:
                rows += [(a, n) for n in post.get(b, ()) if n not in post[a] - {a}]
    held = {n for _, n in rows}
    rows += [("entry", n) for n in ends - held - {"entry", "exit"}]
    return pd.DataFrame(sorted(set(rows)), columns=["controller", "node"])


def control_dependence(statement_graph: DataFrame) -> DataFrame:
    """``fn_id``, ``controller``, ``node``. Statements that nothing controls depend on ``entry``;
    those from which the exit can't be reached are left out. One function is one group."""

    def each(part: pd.DataFrame) -> pd.DataFrame:
        out = _dependence(part)
        out.insert(0, "fn_id", part.fn_id.iloc[0])
        return out

    return statement_graph.groupBy("fn_id").applyInPandas(each, "fn_id string, controller string, node string")


def reaching_definitions(functions: DataFrame, statement_graph: DataFrame) -> DataFrame:
    """``fn_id``, ``node``, ``var``, ``def``: definitions that hold where a statement begins.

    A strong assignment ends others of its variable; weak ones (an element, an augmented value) add
    to them. Parameters are defined at ``entry``. A breadth-first loop over (node, variable, definition).
    """
    made = facts.assignments(functions).select("fn_id", _node("block", "idx").alias("node"), F.col("target").alias("var"), "strong")
    params = functions.select("fn_id", F.lit("entry").alias("node"), F.explode("params").alias("var"), F.lit(True).alias("strong"))
    made = kept(made.union(params).groupBy("fn_id", "node", "var").agg(F.max("strong").alias("strong")))
    kill = made.where("strong").select("fn_id", "node", "var")
    e = kept(statement_graph.select("fn_id", F.col("src").alias("node"), "dst").distinct())
    leaving = made.select("fn_id", "node", "var", F.col("node").alias("def"))
    known = None
    for _ in range(graph.ROUNDS):
        step = leaving.join(e, ["fn_id", "node"]).select("fn_id", F.col("dst").alias("node"), "var", "def").distinct()
        step = kept(step if known is None else step.join(known, ["fn_id", "node", "var", "def"], "left_anti"))
        if step.isEmpty():
            break
        known = step if known is None else kept(known.union(step))
        leaving = step.join(kill, ["fn_id", "node", "var"], "left_anti")
    return known if known is not None else leaving.limit(0)


def uses(functions: DataFrame, reaching: DataFrame) -> DataFrame:
    """Definition to use: ``fn_id``, ``def``, ``node``, ``var`` where a statement reads the variable."""
    s = facts.statements(functions).select("fn_id", _node("block", "idx").alias("node"), "assigns", "calls", "ret", "cond")
    read = F.concat(
        F.flatten(F.transform("assigns", lambda a: a["paths"])),
        F.flatten(F.transform("calls", lambda c: F.concat(c["recv"]["paths"], F.flatten(F.transform(c["args"], lambda a: a["paths"]))))),
        F.coalesce(F.col("ret.paths"), F.array().cast("array<string>")),
        F.coalesce(F.col("cond.paths"), F.array().cast("array<string>")),
    )
    own = s.select("fn_id", "node", F.explode(F.array_distinct(F.transform(read, lambda p: F.regexp_extract(p, r"^[^.\[]+", 0)))).alias("var"))
    return own.join(reaching, ["fn_id", "node", "var"]).select("fn_id", "def", "node", "var").distinct()


def merged(states: Iterator[set]) -> set:
    """What all of several states hold."""
    states = list(states)
    return set.intersection(*states) if states else set()
