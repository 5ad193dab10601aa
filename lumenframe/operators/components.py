"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.session import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of an edge; the component is its smallest node.

    Each round gives a node the smallest label among its own, its neighbours' and that of the node
    its label names, so the distance covered doubles; rounds stop when no label changes. Rounds are
    written. Loops and repeated edges do no harm, NULL ends are left out; no edges give no
    rows. A node with very many edges only sends and receives pre-aggregated minima.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    e = written(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    if e.isEmpty():
        return e.select(F.col("x").alias("node"), F.col("x").alias("component"))
    labels = written(e.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("l")).withColumnRenamed("x", "n"))
    for _ in range(max_rounds):
        near = e.join(labels, F.col("y") == F.col("n"), "inner").groupBy("x").agg(F.min("l").alias("m"))
        stepped = labels.join(near, F.col("n") == F.col("x"), "left").select("n", "l", F.least("l", F.coalesce("m", "l")).alias("k"))
        jump = stepped.select(F.col("n").alias("t"), F.col("k").alias("t_label"))
        fresh = written(stepped.join(jump, F.col("k") == F.col("t"), "left").select("n", F.col("l").alias("was"), F.least("k", F.coalesce("t_label", "k")).alias("l")))
        changed = not fresh.where("l <> was").isEmpty()
        labels = fresh.select("n", "l")
        if not changed:
            break
    else:
        raise RuntimeError(f"labels still change after {max_rounds} rounds")
    return labels.select(F.col("n").alias("node"), F.col("l").alias("component"))
