"""Connected components by repeated contraction, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.chunks import table


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node of a link the smallest node it reaches.

    A round hooks each node to the smallest of its neighbours and itself,
    follows the hooks to their ends, and keeps the links between different ends.
    Each round at least halves the nodes that still have links. Neighbours are only ever
    reduced to their minimum (a partial aggregate), and the joins are inner joins of many
    rows to one, whose crowded keys adaptive execution splits. Nothing is collected.
    """
    x, y = F.col(a), F.col(b)
    edges = table(links.filter(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct(), "links")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = table(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "hooks")
        while True:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = table(hook.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "hooks")
            hook = jumped.select("node", "root")
            if jumped.filter("moved").isEmpty():
                break
        rounds.append(hook)
        left = hook.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = table(edges.join(left, "a").join(right, "b").filter("ra != rb")
                      .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    if not rounds:
        return links.select(x.alias("node"), x.alias("root")).limit(0)
    found = rounds[0]
    for hook in rounds[1:]:
        step = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return found
