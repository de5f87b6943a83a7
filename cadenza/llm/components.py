"""Connected components of a link table, by hooking, pointer jumping and contraction; nothing but single numbers reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a, b); component is the smallest id that links reach. Ids must not be null.

    Each round every node hooks to its smallest neighbour, the trees that come of it are flattened by doubling, and links are
    contracted to the trees' roots; rounds are at most logarithmic in the nodes. Tables that are joined come from the checkpoint
    folder, so that a join with a hot root can be split by the engine.
    """
    rest = cut(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not rest.isEmpty():
        ends = rest.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("e")).select("e.*")
        parents = cut(ends.groupBy("id").agg(F.min("other").alias("other")).select("id", F.least("id", "other").alias("root")))
        while True:
            up = parents.select(F.col("id").alias("root"), F.col("root").alias("above"))
            jumped = cut(parents.join(up, "root").select("id", F.col("above").alias("root"), (F.col("above") < F.col("root")).alias("moved")))
            parents = jumped.select("id", "root")
            if jumped.filter("moved").isEmpty():
                break
        if labels is None:
            labels = parents.select("id", F.col("root").alias("component"))
        else:
            up = parents.select(F.col("id").alias("component"), "root")
            labels = cut(labels.join(up, "component", "left").select("id", F.coalesce("root", "component").alias("component")))
        a, b = parents.select(F.col("id").alias("a"), F.col("root").alias("x")), parents.select(F.col("id").alias("b"), F.col("root").alias("y"))
        inner = rest.join(a, "a").select("b", "x").join(b, "b").filter("x <> y")
        rest = cut(inner.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return labels if labels is not None else rest.select(F.col("a").alias("id"), F.col("b").alias("component"))
