"""Connected components over an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.session import stored


#: Nodes with more edges than this, and than a 10,000th of all edge ends, have their edges dealt over SALTS tasks.
HEAVY, SALTS = 1000, 64


def _hooked(edges: DataFrame, ends: int) -> DataFrame:
    """(u, v, m): every edge with the smallest neighbour of u, u itself counted.

    A hub's edges do not meet in a task: nodes of many edges (10,000 of them at
    most, as their edges add up to no more than ``ends``) are joined in parts.
    """
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), (F.col("n") > max(HEAVY, ends // 10_000)).alias("heavy"))
    if ends <= HEAVY:
        return edges.join(low.select("u", "m"), "u")
    heavy = F.broadcast(low.filter("heavy").select("u", "heavy"))
    salt = F.when(F.col("heavy"), F.pmod(F.xxhash64("v"), F.lit(SALTS))).otherwise(0).cast("int")
    dealt = edges.join(heavy, "u", "left").select("u", "v", salt.alias("salt"))
    parts = low.select("u", "m", F.explode(F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    return dealt.join(parts, ["u", "salt"]).select("u", "v", "m")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): every node of ``edges`` (u, v: long) with the smallest node it can reach.

    Each round hooks every node's larger neighbours, then its smaller ones, to
    its smallest neighbour; the edge count never grows and the diameter falls
    geometrically, so a few rounds do. Smallest neighbours are aggregated with
    map-side combine, and the edges of hubs are joined to them in parts, so no
    node's neighbourhood is gathered in a task.
    Null ends and self loops are ignored; an empty table gives an empty result.
    """
    e = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v")
    e = stored(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    nodes, count = e, e.count()
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hooked(both, 2 * count).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        small = _hooked(large, 2 * count).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        new = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = stored(new, "edges")
        # a node with one smaller neighbour which has none itself: all stars, nothing left to hook
        roots = new.select(F.col("v").alias("u")).distinct()
        open_ = new.join(roots, "u", "left_semi").limit(1).count() or new.groupBy("u").count().filter("count > 1").limit(1).count()
        e, count = new, new.count()
        if not open_:
            break
    else:
        raise RuntimeError("the components did not converge")
    ends = nodes.select(F.col("u").alias("node")).unionByName(nodes.select(F.col("v").alias("node"))).distinct()
    return ends.join(e.select(F.col("u").alias("node"), F.col("v").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
