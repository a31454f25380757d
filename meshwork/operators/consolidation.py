"""A consolidation cycle over a graph of memories: it strengthens, links, groups and prunes in phases.

Phases, each a DataFrame job on what the one before left: activation spreads from every node and strengthens the edges
on its way; near-equal nodes are superseded by the older one; nodes of small communities are tied to their nearest
others; each community gets an insight node; edges whose weight has decayed below a threshold go.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.operators import algorithms
from meshwork.plans.lineage import written as settled


@dataclass(frozen=True)
class Settings:
    decay: float = 0.5
    threshold: float = 0.01
    hops: int = 2
    per_seed: int = 10
    gain: float = 0.1
    alike: float = 0.95
    isolated: int = 5
    forget: float = 0.05


@dataclass(frozen=True)
class Outcome:
    edges: DataFrame
    superseded: DataFrame
    communities: DataFrame
    insights: DataFrame
    report: DataFrame


def cycle(edges: DataFrame, vertices: DataFrame, how: Settings | None = None) -> Outcome:
    """One cycle over edges (src, dst, weight) and vertices (id)."""
    how = how or Settings()
    e = settled(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).filter("src <> dst"))
    spread = algorithms.batch_spread(e, vertices, how.decay, how.threshold, how.hops, how.per_seed)
    # edges between a seed and what it activates grow, towards 1; the others fade
    got = spread.groupBy(F.least("seed", "node_id").alias("a"), F.greatest("seed", "node_id").alias("b")).agg(F.max("activation").alias("act"))
    near = e.join(got, (F.least("src", "dst") == F.col("a")) & (F.greatest("src", "dst") == F.col("b")), "left")
    strong = settled(near.select("src", "dst", F.when(F.col("act").isNotNull(), F.least(F.lit(1.0), F.col("weight") + how.gain * F.col("act"))).otherwise(F.col("weight") * (1 - how.gain)).alias("weight")))
    superseded = settled(strong.filter(F.col("weight") >= how.alike).groupBy(F.greatest("src", "dst").alias("old")).agg(F.min(F.least("src", "dst")).alias("by")))
    communities = settled(algorithms.louvain(strong, vertices).select("node_id", "community_id"))
    sizes = communities.groupBy("community_id").agg(F.count("*").alias("members"))
    lone = communities.join(sizes.filter(F.col("members") < how.isolated), "community_id").select(F.col("node_id").alias("seed"))
    ties = spread.filter("hop = 2").join(lone, "seed").groupBy("seed").agg(F.max(F.struct("activation", "node_id")).alias("b"))
    ties = ties.select(F.col("seed").alias("src"), F.col("b.node_id").alias("dst"), F.col("b.activation").alias("weight"))
    insights = settled(sizes.filter(F.col("members") >= how.isolated).withColumnRenamed("community_id", "insight"))
    kept = settled(strong.unionByName(ties).filter(F.col("weight") >= how.forget))
    counts = [("strengthened", strong.join(e.select("src", "dst", F.col("weight").alias("w")), ["src", "dst"]).filter("weight > w")), ("superseded", superseded), ("communities", sizes), ("tied", ties), ("insights", insights), ("edges", kept)]
    report = edges.sparkSession.createDataFrame([(k, v.count()) for k, v in counts], "phase string, n long")
    return Outcome(kept, superseded, communities, insights, report)
