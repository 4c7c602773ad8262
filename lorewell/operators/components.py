"""Connected components of an edge table, by rounds of joins; no edge or component reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written


def components(edges: DataFrame, path: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) of each node of edges (a, b): root is the smallest node that can be reached.

    Each round links every node's larger neighbours, and the node itself, to
    its smallest neighbour (large star, then small star), which halves paths;
    it ends when no edge changes. A node with many edges is one group of an
    aggregate with a minimum, so it is reduced before it is shuffled. Each
    round is a written table under path.
    """
    content = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{path}/cc0")
    last = content(e)
    for k in range(1, most_rounds + 1 if last[0] else 1):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        new = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).distinct()
        e = written(new, f"{path}/cc{k}")
        now = content(e)
        if now == last:
            break
        last = now
    else:
        if last[0]:
            raise RuntimeError(f"components are not found after {most_rounds} rounds")
    roots = e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
