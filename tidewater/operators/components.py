"""Connected components by contraction: every node points to its smallest neighbour, pointers
are jumped, the graph shrinks to the roots. No group is ever gathered in one task; only
aggregates with map-side combine and equi-joins are used, so AQE can split a hot hub."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that occurs in an edge; the component is the
    smallest node of it. Loops and repeated edges are harmless, null ends are ignored, no
    edges give no rows. Node ids may be of any ordered type."""
    e = (
        edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
        .where("u IS NOT NULL AND v IS NOT NULL")
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
    )
    e = materialize(e, "edges")
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    labels = None
    for _ in range(max_rounds):
        e = e.where("u < v")
        if e.isEmpty():
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("p"))
        parent = _to_roots(materialize(parent, "parents"))
        to = parent.select(F.col("node").alias("k"), F.col("p").alias("kp"))
        e = e.join(to, e.u == to.k).select(F.col("kp").alias("u"), "v")
        e = e.join(to, e.v == to.k).select("u", F.col("kp").alias("v"))
        e = materialize(
            e.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges"
        )
        if labels is None:
            labels = parent.withColumnRenamed("p", "component")
        else:
            t = to.withColumnRenamed("k", "component")
            labels = labels.join(t, "component", "left").select(
                "node", F.coalesce("kp", "component").alias("component")
            )
            labels = materialize(labels, "labels")
    else:
        raise RuntimeError("components did not settle")
    if labels is None:
        return nodes.select("node", F.col("node").alias("component"))
    # Nodes that only have loops point to themselves.
    return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _to_roots(parent: DataFrame, jumps: int = 2) -> DataFrame:
    """Pointer jumping until every node points to a root: the length of a path shrinks to a
    quarter with every written table. Afterwards only local minima are left as roots, so the
    next round has at most half the nodes."""
    while True:
        new = parent
        for _ in range(jumps):
            up = new.select(F.col("node").alias("k"), F.col("p").alias("kp"))
            new = new.join(up, new.p == up.k).select("node", F.col("kp").alias("p"), F.col("p").alias("was"))
            moved = F.col("p") != F.col("was")
            new = new.withColumn("moved", moved)
        new = materialize(new.select("node", "p", "moved"), "parents")
        if new.where("moved").isEmpty():
            return new.select("node", "p")
        parent = new.select("node", "p")
