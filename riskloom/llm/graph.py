"""Connected components of an undirected graph, as Spark jobs.

Each round lets every node point its larger neighbours, and then its smaller ones, to the smallest node it sees
(large star, small star). The graph ends as one star per component after about log(n) rounds. Nothing of it
goes through the driver but a count and a checksum per round. Every round ends in checkpoint(), which writes to
the shared folder and cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import ensure_checkpoint_dir


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): for every node with an edge to another one, the smallest node of its component.

    Nulls, loops and repeated edges count for nothing; no edges give an empty table.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    links = links.distinct().checkpoint()
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        links = _small_star(_large_star(links)).checkpoint()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    far = both.where("v > u").join(least, "u")
    return far.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    near = links.join(least, "u")
    moved = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
