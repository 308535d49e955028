"""Traversals and fixpoints over edge tables (src, dst, kind).

Every loop is a join of the frontier with the edges, an anti join with what is known, and a
written table a round; nothing but a count comes to the driver. Nodes may be of any type that
has an order. Loops and repeated edges are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.sources.scratch import kept

ROUNDS = 1000


def directed(edges: DataFrame, kinds: list[str] | None = None, backward: bool = False) -> DataFrame:
    """``src`` and ``dst`` of the edges of ``kinds``, turned round if asked for."""
    e = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    return (e.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if backward else e.select("src", "dst")).distinct()


def reach(edges: DataFrame, starts: DataFrame, kinds: list[str] | None = None, backward: bool = False) -> DataFrame:
    """G1: ``node`` and ``depth`` of all that ``starts`` (node) reach, themselves at depth 0."""
    e = kept(directed(edges, kinds, backward))
    known = kept(starts.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = known
    for depth in range(1, ROUNDS):
        step = frontier.join(e, frontier.node == e.src).select(F.col("dst").alias("node")).distinct().join(known.select("node"), "node", "left_anti")
        frontier = kept(step.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        known = kept(known.unionByName(frontier))
    return known


def shortest_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """For each of ``ends`` (node) that is reached the shortest path from a start, as ``path``.

    Breadth first from all starts at once; of several predecessors the least counts. A node
    that is itself a start is seeded without a predecessor and so is never an answer.
    """
    e = kept(directed(edges, kinds))
    out = starts.select("node").distinct().join(e.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
    known = kept(out.withColumn("path", F.array("node")))
    frontier = known
    for _ in range(1, ROUNDS):
        step = frontier.join(e, frontier.node == e.src).groupBy("dst").agg(F.min(F.struct(F.col("node").alias("via"), "path")).alias("from"))
        step = step.select(F.col("dst").alias("node"), F.concat("from.path", F.array("dst")).alias("path")).join(known.select("node"), "node", "left_anti")
        frontier = kept(step)
        if frontier.isEmpty():
            break
        known = kept(known.unionByName(frontier))
    return known.join(ends.select("node").distinct(), "node", "left_semi").where("size(path) > 1")


def slice_forward(edges: DataFrame, nodes: DataFrame, name: str, kinds: list[str] | None = None) -> DataFrame:
    """What values of ``name`` reach: seeds are ``nodes`` (node, var) whose variable, its root or its last segment is ``name``."""
    var = F.col("var")
    seed = (var == name) | (F.regexp_extract(var, r"^[^.\[-]+", 0) == name) | (F.element_at(F.split(var, r"\."), -1) == name)
    return reach(edges, nodes.where(seed).select("node"), kinds)


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the least node of its undirected component."""
    both = directed(edges).union(directed(edges, backward=True)).distinct()
    both = kept(both)
    label = kept(both.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")))
    for _ in range(ROUNDS):
        near = both.join(label, both.dst == label.node).groupBy(F.col("src").alias("node")).agg(F.min("component").alias("other"))
        new = label.join(near, "node").select("node", F.least("component", "other").alias("component"))
        # hang every node on its label's own label: paths halve with each round
        new = kept(new.join(new.select(F.col("node").alias("component"), F.col("component").alias("above")), "component").select("node", F.least("component", "above").alias("component")))
        changed = not new.join(label, ["node", "component"], "left_anti").isEmpty()
        label = new
        if not changed:
            break
    return label


def _colours(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """Least node that reaches each node along ``e``."""
    colour = kept(nodes.withColumn("colour", F.col("node")))
    for _ in range(ROUNDS):
        before = e.join(colour, e.src == colour.node).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("other"))
        new = kept(colour.join(before, "node", "left").select("node", F.least("colour", F.coalesce("other", "colour")).alias("colour")))
        changed = not new.join(colour, ["node", "colour"], "left_anti").isEmpty()
        colour = new
        if not changed:
            break
    return colour


def strongly_connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the least node of its strongly connected component.

    By colouring: nodes take the least node that reaches them; those that reach the colour's own
    node inside the colour are its component; the rest goes on.
    """
    e = kept(directed(edges))
    nodes = kept(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    done = None
    for _ in range(ROUNDS):
        colour = _colours(e, nodes)
        inside = e.join(colour.withColumnRenamed("node", "src").withColumnRenamed("colour", "a"), "src").join(colour.withColumnRenamed("node", "dst").withColumnRenamed("colour", "b"), "dst")
        inside = kept(inside.where("a = b").select("src", "dst"))
        back = reach(inside.withColumn("kind", F.lit("x")), colour.where("node = colour").select("node"), backward=True).select("node")
        found = kept(colour.join(back, "node", "left_semi").withColumnRenamed("colour", "component"))
        done = found if done is None else kept(done.unionByName(found))
        nodes = kept(nodes.join(found.select("node"), "node", "left_anti"))
        if nodes.isEmpty():
            break
        e = kept(e.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    return done


def recursive_groups(edges: DataFrame) -> DataFrame:
    """``component`` and its sorted ``members`` of components of several nodes or with a loop."""
    own = strongly_connected(edges)
    loops = edges.where("src = dst").select(F.col("src").alias("component")).distinct().withColumn("loop", F.lit(True))
    grouped = own.groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("members"))
    return grouped.join(loops, "component", "left").where((F.size("members") > 1) | F.col("loop")).select("component", "members")


def cycles(edges: DataFrame) -> DataFrame:
    """Dependency cycles, the components of several nodes, sorted."""
    return recursive_groups(edges.where("src != dst"))


def levels(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` and ``level`` of the graph of components: 0 without
    outgoing edges to other components, else one more than the highest level they lead to."""
    own = kept(strongly_connected(edges))
    e = directed(edges).join(own.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(own.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
    e = kept(e.where("a != b").select("a", "b").distinct())
    level = kept(own.select("component").distinct().withColumn("level", F.lit(0)))
    for n in range(1, ROUNDS):
        up = e.join(level.where(F.col("level") == n - 1), e.b == F.col("component")).select(F.col("a").alias("component")).distinct().withColumn("up", F.lit(n))
        up = kept(up)
        if up.isEmpty():
            break
        level = kept(level.join(up, "component", "left").select("component", F.coalesce("up", "level").alias("level")))
    return own.join(level, "component").select("node", "component", "level")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge of another node leads to."""
    return nodes.select("node").distinct().join(edges.where("src != dst").select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def closure(edges: DataFrame) -> DataFrame:
    """``low``, ``high`` and least ``depth`` for all ancestors of each node along (src, dst)."""
    e = kept(directed(edges))
    known = kept(e.select(F.col("src").alias("low"), F.col("dst").alias("high"), F.lit(1).alias("depth")))
    frontier = known
    for depth in range(2, ROUNDS):
        step = frontier.join(e, frontier.high == e.src).select("low", F.col("dst").alias("high")).distinct().join(known.select("low", "high"), ["low", "high"], "left_anti")
        frontier = kept(step.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        known = kept(known.unionByName(frontier))
    return known


def collapsed(edges: DataFrame, path: Column | None = None) -> DataFrame:
    """File edges (src, dst, imports, calls, examples) between directories: no own edges, calls
    summed, imports put together, the three least examples."""
    folder = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    e = edges.withColumn("src", folder("src")).withColumn("dst", folder("dst")).where("src != dst")
    return e.groupBy("src", "dst").agg(
        F.sum("calls").alias("calls"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("imports")))).alias("imports"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("examples")))), 1, 3).alias("examples"),
    )


def subtree(nodes: DataFrame, root: str, stops: list[str] | None = None) -> DataFrame:
    """Nodes (id, kind, parent, ord) below ``root`` in preorder; below a node of a kind of ``stops`` nothing is entered."""
    frontier = kept(nodes.where(F.col("id") == root).withColumn("order_key", F.array(F.lit(0))))
    known = frontier
    for _ in range(ROUNDS):
        above = frontier.where(~F.col("kind").isin(stops)) if stops else frontier
        step = nodes.join(above.select(F.col("id").alias("above"), F.col("order_key").alias("high")), F.col("parent") == F.col("above"))
        frontier = kept(step.select(*nodes.columns, F.concat("high", F.array("ord")).alias("order_key")))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    rank = F.row_number().over(Window.orderBy("order_key"))
    return known.withColumn("preorder", rank).drop("order_key")


def enclosing(nodes: DataFrame, kind: str) -> DataFrame:
    """For each node the nearest of its ancestors, itself included, that is of ``kind``: id, owner."""
    at = kept(nodes.select("id", F.col("id").alias("now"), "kind", "parent"))
    found = kept(at.where(F.col("kind") == kind).select("id", F.col("now").alias("owner")))
    left = at.where(F.col("kind") != kind).select("id", "parent")
    for _ in range(ROUNDS):
        up = left.join(nodes.select(F.col("id").alias("now"), "kind", F.col("parent").alias("next")), F.col("parent") == F.col("now"))
        up = kept(up.select("id", "now", "kind", "next"))
        if up.isEmpty():
            break
        found = found.union(up.where(F.col("kind") == kind).select("id", "now"))
        left = up.where(F.col("kind") != kind).select("id", F.col("next").alias("parent"))
    return found


def numbered(nodes: DataFrame, base: Column, order: list[Column]) -> DataFrame:
    """``stable_id``: the base, with ``:1``, ``:2`` ... for its repeats in ``order``."""
    n = F.row_number().over(Window.partitionBy("_base").orderBy(*order)) - 1
    out = nodes.withColumn("_base", base).withColumn("_n", n)
    return out.withColumn("stable_id", F.when(F.col("_n") == 0, F.col("_base")).otherwise(F.concat_ws(":", "_base", F.col("_n").cast("string")))).drop("_base", "_n")


def changed_files(before: DataFrame, now: DataFrame) -> DataFrame:
    """``file`` and ``action`` (write or delete) from the digests (file, digest) of two states."""
    a, b = before.select("file", F.col("digest").alias("old")), now.select("file", F.col("digest").alias("new"))
    action = F.when(F.col("new").isNull(), "delete").when(F.col("old").isNull() | (F.col("old") != F.col("new")), "write")
    return a.join(b, "file", "full").select("file", action.alias("action")).where("action IS NOT NULL")
