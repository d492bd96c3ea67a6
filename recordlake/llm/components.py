"""Connected components of a distributed edge list, by contraction.

Each round every node hooks onto its smallest neighbour if that is smaller than itself, hooks are
shortened by pointer jumping, and the edges are rewritten between what the nodes became. A hook
always points to a smaller member of the same component, so a round never errs; the rounds end when
no edge joins two different nodes. Nothing but one truth value a round reaches the driver, and every
round is a written table, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlake.llm.common import forget, written


def _jump(hooks: DataFrame) -> DataFrame:
    nxt = hooks.select(F.col("node").alias("mid"), F.col("up").alias("top"))
    return hooks.join(nxt, hooks.up == nxt.mid, "left").select("node", F.coalesce("top", "up").alias("up"))


def components(edges: DataFrame, a: str = "a", b: str = "b", jumps: int = 2) -> DataFrame:
    """``node, component`` for each node of an edge between different nodes; the component is its smallest node.

    Edges with a null end and loops are left out; repeated edges count once.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = written(edges.filter(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct(), "edges")
    labels = None
    while True:
        if now.isEmpty():
            break
        hooks = now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        for _ in range(jumps):
            hooks = _jump(written(hooks, "hooks"))
        hooks = written(hooks, "hooks")
        to = lambda side: hooks.select(F.col("node").alias(f"n{side}"), F.col("up").alias(f"u{side}"))
        ends = now.join(to("a"), F.col("a") == F.col("na"), "left").join(to("b"), F.col("b") == F.col("nb"), "left")
        ends = ends.select(F.coalesce("ua", "a").alias("p"), F.coalesce("ub", "b").alias("q")).filter("p != q")
        later = written(ends.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "edges")
        if labels is None:
            nodes = now.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            labels = written(nodes.join(to(""), F.col("node") == F.col("n"), "left").select("node", F.coalesce("u", "node").alias("component")), "labels")
        else:
            old = labels
            labels = written(labels.join(to(""), F.col("component") == F.col("n"), "left").select("node", F.coalesce("u", "component").alias("component")), "labels")
            forget(old)
        forget(now)
        forget(hooks)
        now = later
    if labels is None:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
