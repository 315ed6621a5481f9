"""Connected components of a graph by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint


#: Edges of a task, and tasks that share the edges of a node.
EDGES, SALTS = 50_000, 8


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it. A node's edges meet its least neighbour in ``SALTS`` tasks."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = both.where("b > a").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    return dealt.join(least, ["a", "salt"]).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. Edges lead down: a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``node, root``: the smallest node that each node can reach.

    Loops and repeated edges do no harm, nodes without an edge do not occur. Each round is written
    to the checkpoint folder; a number of rounds logarithmic in the components' size is enough. The
    steps of a round run in a task for every ``EDGES`` edges, however many partitions a shuffle has.
    """
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = checkpoint(down), None
    n = now.count()
    while True:
        tasks = max(2, -(-n // EDGES))
        large = _large(now.coalesce(tasks)).coalesce(tasks).distinct().coalesce(tasks)
        now = checkpoint(_small(large).coalesce(tasks).distinct().coalesce(tasks))
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == (seen["n"], seen["h"]):
            break
        mark, n = (seen["n"], seen["h"]), seen["n"]
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
