"""Connected components of an undirected graph: alternating large and small stars.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Every round
is two joins on node ids, and its edges are written to the shared folder, so the lineage
stays short and a lost executor costs one round.  Minima are combined before the shuffle.
A hub's edges never meet in one task: the table of minima is broadcast while it has few
rows, and beyond that the minima of the nodes of most edges are (``join_by_size``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sparkloom.plans.shared import MAX_BROADCAST_ROWS, join_by_size, written

#: Rounds grow with the logarithm of the longest path; this many would mean a defect.
MAX_ROUNDS = 60


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and their number and sum of hashes, taken as they are written."""
    seen = Observation()
    out = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges")
    got = seen.get
    return out, (got["n"], got["h"])


def _with_least(edges: DataFrame, n: int) -> DataFrame:
    """The edges, each with the smallest v of its u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if n <= MAX_BROADCAST_ROWS:  # of the edges, so there are no more nodes
        return edges.join(F.broadcast(least.drop("n")), "u")
    return join_by_size(edges, least, ["u"], "n", what="least")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", nodes: DataFrame | None = None) -> DataFrame:
    """(id, component) of every node of an edge, the component being its smallest node.

    nodes: a table whose column id adds isolated nodes.  Edges with a null end and loops
    are dropped; repeated edges count once; no edges give no rows.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    e, state = _kept(e)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * state[0]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        if state[0] > MAX_BROADCAST_ROWS:
            large = written(large.distinct(), "stars")
        near = _with_least(large, state[0])
        small = near.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(large.groupBy("u").agg(F.min("v").alias("v"))).distinct()
        before = state
        e, state = _kept(small)
        if before == state:
            break
    else:
        raise RuntimeError(f"no stable components after {MAX_ROUNDS} rounds")
    out = e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    if nodes is None:
        return out
    return nodes.select("id").distinct().join(out.hint("merge"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
