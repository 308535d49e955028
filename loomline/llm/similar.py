"""Links between similar sets, from bucket keys to verified components.

Sets that share a bucket key are candidates. A bucket's members are first compared with
its least member alone (a star, never all pairs); confirmed links are clustered. Only
members of one bucket that lie in different components and have not been compared can
still hold a link; those are all paired in a second step, a large bucket's in cells of two
blocks, whose sets are compared with each other without a row a pair (:func:`_crowded`).
Other candidates whose signatures agree in far fewer places than two sets as similar as asked
for would are left out before their sets are fetched (:func:`least_agreeing`: a similar
pair is lost with a chance below 1e-9).

A link between different sets is then lost only if they share no key: two sets of
similarity 0.85 share none of 24 bands of 4 values with a chance of 2e-8; for 0.8 and 14
bands of 3 values it is 4e-5.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm import shingles
from loomline.llm.components import components
from loomline.llm.shared import discard, settled, ship, written

#: Rows, and bytes as stored, of a table that may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 8 << 20
#: Members of a bucket that are joined with each other in the second step, and of a block of a larger one.
PAIRED, BLOCK = 40, 1000
#: Shingles of a block, about.
BLOCK_ITEMS = 500_000


def small(df: DataFrame) -> DataFrame:
    """``df``, a written table, marked for broadcast if its rows and bytes are within the bounds."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST_BYTES and df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def least_agreeing(values: int, percent: int, chance: float = 1e-9) -> int:
    """Places that two signatures of ``values`` places agree in at least, but for ``chance``."""
    p, total = percent / 100, 0.0
    for k in range(values + 1):
        total += math.comb(values, k) * p**k * (1 - p) ** (values - k)
        if total > chance:
            return k
    return values


def _likely(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least_agreeing(x.shape[1], percent)))


def _with(pairs: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """``pairs`` (a, b) with ``x`` and ``y``, the ``value`` of either."""
    joined = pairs.join(values.select(F.col("id").alias("b"), F.col(value).alias("y")), "b")
    return joined.join(values.select(F.col("id").alias("a"), F.col(value).alias("x")), "a").select("a", "b", "x", "y")


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) from rows in order of ``hub``, ``part`` and ``side``: the hub's own set comes before the others."""
    hub, own = None, np.empty(0, dtype=np.uint64)
    for batch in batches:
        a, b = [], []
        for h, side, i, x in zip(*(batch.column(c).to_pylist() for c in ("hub", "side", "id", "items")), strict=True):
            q = np.frombuffer(x, dtype="<u8")
            if not side:
                hub, own = h, q
            elif h == hub:
                both = shingles.shared(own, q)
                if 100 * both >= percent * (len(own) + len(q) - both):
                    a.append(h)
                    b.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def confirm(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Of ``pairs`` (a, b), a written table, those whose sets are similar to ``percent`` or more.

    Each pair's ``b`` is sent to its ``a``, so a set is moved once for each pair that it is
    ``b`` of; an ``a`` with many pairs is dealt into parts of about :data:`BLOCK`.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    to = lambda part, side: F.struct(F.col("a").alias("hub"), part.alias("part"), F.lit(side).alias("side"))
    hubs = parts.select(F.col("a").alias("id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "a")
    others = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts").cast("int"))
    roles = hubs.select("id", to(F.col("part"), 0).alias("to")).union(others.select(F.col("b").alias("id"), to(F.col("part"), 1)))
    lists = written(roles.groupBy("id").agg(F.collect_list("to").alias("to")), "lists")
    rows = sets_of(lists.select("id")).join(small(lists), "id").select("id", "items", F.explode("to").alias("to")).select("to.*", "id", "items")
    rows = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "side")
    links = written(rows.mapInArrow(lambda it: _verified(it, percent), "a long, b long").distinct(), "links")
    discard(lists)
    return links


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of buckets of more than one, from rows in order of ``key`` and ``id``.

    ``lo`` and ``m`` are the bucket's least member and its size of set; ``many`` tells whether
    the bucket has more than two members. Repeated rows of a member count once.
    """
    names = ("key", "id", "n")
    held = [np.empty(0, dtype=np.int64) for _ in names]
    begun: tuple[int, int, int] | None = None  # key, least member and its n of a bucket that goes on

    def found(last: bool) -> pa.RecordBatch:
        nonlocal held, begun
        key, ids, n = held
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        size = np.diff(np.append(starts, len(key)))
        lo, m = ids[starts], n[starts]
        if begun and len(key) and key[0] == begun[0]:
            (lo[0], m[0]), size[0] = begun[1:], size[0] + 3
        end = len(key)
        if len(key) and not last:
            if size[-1] > 2:
                begun = (int(key[-1]), int(lo[-1]), int(m[-1]))
            else:  # one more row may show what it is
                end = int(starts[-1])
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))[:end]
        use = np.flatnonzero(size[of] > 1)
        of, held = of[use], [x[end:] for x in held]
        columns = [key[use], ids[use], n[use], lo[of], m[of], size[of] > 2]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*names, "lo", "m", "many"])

    before: tuple[int, int] | None = None  # key and id of the last row
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [batch.column(c).to_numpy() for c in names]
        new = np.append((own[0][0], own[1][0]) != before, (own[0][1:] != own[0][:-1]) | (own[1][1:] != own[1][:-1]))
        before = own[0][-1], own[1][-1]
        held = [np.concatenate([h, c[new]]) for h, c in zip(held, own, strict=True)]
        yield found(False)
    yield found(True)


def _cell(table: pa.Table, percent: int) -> pa.Table:
    """Links between different components in a cell: its two blocks, or its one block."""
    block, ids, component = (table.column(c).to_numpy() for c in ("block", "id", "component"))
    component = component.copy()
    sets = [np.frombuffer(x, dtype="<u8") for x in table.column("items").to_pylist()]
    n = np.array([len(x) for x in sets])
    starts = np.append(0, np.cumsum(n))
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = [codes[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
    marked = np.zeros(int(codes.max(initial=-1)) + 1, dtype=bool)
    one = block.min() == block.max()
    left = np.flatnonzero(block == block.min())
    right = left if one else np.flatnonzero(block != block.min())
    a, b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for at, i in enumerate(left):
        to = right[at + 1 :] if one else right
        to = to[(component[to] != component[i]) & (100 * np.minimum(n[to], n[i]) >= percent * np.maximum(n[to], n[i]))]
        if not len(to):
            continue
        marked[own[i]] = True
        both = np.add.reduceat(marked[np.concatenate([own[j] for j in to])], np.cumsum(n[to]) - n[to], dtype=np.int64)
        marked[own[i]] = False
        to = to[100 * both >= percent * (n[to] + n[i] - both)]
        a.append(np.full(len(to), ids[i]))
        b.append(ids[to])
        # what has become one component needs no link between its members
        component[np.isin(component, component[to])] = component[i]
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})


def _crowded(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of large buckets that lie in different components.

    A bucket's members are dealt into blocks of about :data:`BLOCK`, fewer if their sets are
    large; every two blocks, and each one alone, are a cell. All pairs of a cell are compared,
    so none is left out, and a task holds two blocks however large the bucket is.
    """
    blocks = F.ceil(F.greatest(F.col("left") / BLOCK, F.col("items") / BLOCK_ITEMS)).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, "block").alias("x"), F.greatest(i, "block").alias("y")))
    dealt = rest.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.select("key", F.explode(cells).alias("cell"), "block", "id", "component").join(sets, "id")
    return dealt.groupBy("key", "cell").applyInArrow(lambda t: _cell(t.select(["block", "id", "component", "items"]), percent), "a long, b long")


def clusters(units: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> tuple[DataFrame, DataFrame]:
    """Components of similar units, and the links that were confirmed.

    ``units`` is a written table with ``id``, set size ``n``, ``keys`` and signature ``sig``,
    equal in all rows of one id; ``sets_of`` gives ``id`` and ``items`` (sorted 64-bit numbers)
    for a written table of distinct ids, some perhaps more than once.
    Returns (node, component) for units with a link, and links (a, b).
    """
    spark = units.sparkSession
    ship(spark)
    members = units.select(F.explode("keys").alias("key"), "id", F.col("n").cast("long").alias("n"))
    members = members.repartition("key").sortWithinPartitions("key", "id")
    held = written(members.mapInArrow(_together, "key long, id long, n long, lo long, m long, many boolean"), "members")
    settled(spark)
    stars = held.where("id != lo").select(F.col("lo").alias("a"), F.col("m").alias("n"), F.col("id").alias("b"), F.col("n").alias("m"))
    alike = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    tried = written(stars.where(alike).select("a", "b").distinct(), "pairs")
    settled(spark)
    links = _linked(tried, units, sets_of, percent)
    found = written(components(links), "components")

    # what is left: members of one bucket in different components
    placed = held.where("many").drop("m").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("left"), F.sum("n").alias("items")).where("x != y").select("key", "left", "items")
    rest = written(placed.join(several, "key").select("key", "left", "items", "id", "n", "component"), "rest")
    settled(spark, held)
    each = rest.where(F.col("left") <= PAIRED)
    other = each.select("key", F.col("id").alias("b"), F.col("n").alias("m"), F.col("component").alias("other"))
    direct = each.join(other, "key").where((F.col("id") < F.col("b")) & (F.col("component") != F.col("other")) & alike)
    more = direct.select(F.col("id").alias("a"), "b").distinct().join(tried, ["a", "b"], "left_anti")
    more = written(more, "pairs")
    large = rest.where(F.col("left") > PAIRED)
    extra = [] if more.isEmpty() else [_linked(more, units, sets_of, percent)]
    if not large.isEmpty():
        ids = written(large.select("id").distinct(), "ids")
        sets = written(sets_of(ids).dropDuplicates(["id"]), "sets")
        extra.append(written(_crowded(large, sets, percent).distinct(), "links"))
        settled(spark, sets, ids)
    settled(spark, rest, tried, more)
    if all(e.isEmpty() for e in extra):
        discard(*extra)
        return found, links
    discard(found)
    for e in extra:
        links = links.union(e)
    return written(components(links), "components"), links


def _linked(pairs: DataFrame, units: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    ids = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    sigs = written(units.select("id", "sig").join(small(ids), "id", "left_semi").dropDuplicates(["id"]), "sigs")
    likely = written(_with(pairs, small(sigs), "sig").mapInArrow(lambda it: _likely(it, percent), "a long, b long"), "likely")
    if likely.isEmpty():
        return likely
    links = confirm(likely, sets_of, percent)
    settled(pairs.sparkSession, likely, ids, sigs)
    return links
