"""Connected components of links between rows, by alternating star contractions on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import in_bucket, materialize


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component_id) of every id in links (a, b): the smallest id reachable. Ids in no link are not returned.

    Large star: every node tells its larger neighbours its smallest neighbour. Small star: every node tells its smaller
    neighbours the smallest of them. Minima are aggregated before they join, and the neighbours of a hub are dealt to
    several tasks. Ends when a round changes nothing, in a number of rounds logarithmic in practice.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = materialize(edges, "links")
    before = _signature(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("_k")).agg(F.least(F.col("_k"), F.min("v")).alias("m"), F.count("*").alias("n"))
        large = in_bucket(both.filter("v > u"), "u", materialize(least, "least"), "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u <> v").distinct(), "large")
        least = materialize(large.groupBy(F.col("u").alias("_k")).agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = in_bucket(large, "u", least, "v").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select(F.col("_k").alias("u"), F.col("m").alias("v")))
        edges = materialize(small.filter("u <> v").distinct(), "small")
        after = _signature(edges)
        if after == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
        before = after
    raise RuntimeError("components did not settle")
