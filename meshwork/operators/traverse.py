"""Paths over edge tables (_src, _dst, ...): reachability, walks, trails and cheapest paths."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshwork.plans.lineage import written as settled

#: Hops of an unbounded pattern.
MOST_HOPS = 30
#: Rounds of `cheapest` before nodes are counted, to tell a long path from a cycle of negative cost.
COUNTED = 100
#: Levels that stay one lazy plan; beyond, each level is checkpointed and the loop ends when none is new.
LAZY = 3


def oriented(edges: DataFrame, direction: str, apart: bool = False) -> DataFrame:
    """Edges as (s, d, e), e naming the edge; `both` takes either way, so a self-loop counts twice.

    With `apart`, equal parallel edges get names of their own, which costs a shuffle; only trails need it.
    """
    props = [F.col(c).cast("string") for c in edges.columns if c not in ("_src", "_dst")]
    if apart:
        edges = edges.withColumn("_nth", F.row_number().over(W.partitionBy("_src", "_dst", *props).orderBy(F.lit(0))))
        props = [*props, F.col("_nth")]
    name = F.xxhash64("_src", "_dst", *props)
    out = edges.select(F.col("_src").alias("s"), F.col("_dst").alias("d"), name.alias("e"))
    back = edges.select(F.col("_dst").alias("s"), F.col("_src").alias("d"), name.alias("e"))
    return {"out": out, "in": back}.get(direction) if direction != "both" else out.unionByName(back)


def _start(sources: DataFrame, edges: DataFrame) -> DataFrame:
    kind = edges.schema["s"].dataType.simpleString()
    return sources.select(F.col("id").alias("src")).distinct().select("src", F.col("src").cast(kind).alias("node"), F.array(F.col("src").cast(kind)).alias("nodes"), F.array().cast("array<bigint>").alias("rels"))


def reach(sources: DataFrame, edges: DataFrame, low: int = 1, high: int | None = None) -> DataFrame:
    """(src, dst, length, nodes, rels): every node at low..high hops, once, at its distance, by its smallest path."""
    high = MOST_HOPS if high is None else high
    frontier = _start(sources, edges)
    seen = frontier.select("src", "node")
    levels = [frontier.withColumn("length", F.lit(0))] if low == 0 else []
    for hop in range(1, high + 1):
        step = frontier.join(edges, F.col("node") == F.col("s")).select("src", F.col("d").alias("node"), F.struct(F.concat("nodes", F.array("d")).alias("nodes"), F.concat("rels", F.array("e")).alias("rels")).alias("p"))
        step = step.groupBy("src", "node").agg(F.min("p").alias("p"))
        step = step.join(seen, ["src", "node"], "left_anti").select("src", "node", "p.nodes", "p.rels")
        if high > LAZY:
            step = settled(step)
            if step.isEmpty():
                break
        frontier = step
        if hop >= low:
            levels.append(step.withColumn("length", F.lit(hop)))
        if hop < high:
            seen = seen.unionByName(step.select("src", "node"))
    if not levels:
        levels = [frontier.withColumn("length", F.lit(0)).limit(0)]
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.select("src", F.col("node").alias("dst"), "length", "nodes", "rels")


def walks(sources: DataFrame, edges: DataFrame, low: int, high: int, mode: str = "walk") -> DataFrame:
    """(src, dst, length, nodes, rels): all walks of low..high hops; trails repeat no edge, acyclic ones no node."""
    frontier = _start(sources, edges)
    levels = [frontier.withColumn("length", F.lit(0))] if low == 0 else []
    for hop in range(1, high + 1):
        step = frontier.join(edges, F.col("node") == F.col("s"))
        if mode == "trail":
            step = step.filter(~F.array_contains("rels", F.col("e")))
        elif mode == "acyclic":
            step = step.filter(~F.array_contains("nodes", F.col("d")))
        step = step.select("src", F.col("d").alias("node"), F.concat("nodes", F.array("d")).alias("nodes"), F.concat("rels", F.array("e")).alias("rels"))
        if high > LAZY:
            step = settled(step)
            if step.isEmpty():
                break
        frontier = step
        if hop >= low:
            levels.append(step.withColumn("length", F.lit(hop)))
    if not levels:
        levels = [frontier.withColumn("length", F.lit(0)).limit(0)]
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.select("src", F.col("node").alias("dst"), "length", "nodes", "rels")


def cheapest(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, cost) for edges (src, dst, weight >= 0): relaxation of improved nodes until none improves.

    Raises an error on a cycle of negative cost, where nodes improve for more rounds than there are nodes.
    """
    best = settled(sources.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("cost")).distinct())
    active = best
    e = edges.groupBy(F.col("src").alias("s"), F.col("dst").alias("d")).agg(F.min("weight").alias("w"))
    most = None
    for hop in count(1):
        step = active.join(e, F.col("dst") == F.col("s")).select("src", F.col("d").alias("dst"), (F.col("cost") + F.col("w")).alias("cost"))
        both = best.withColumn("new", F.lit(False)).unionByName(step.withColumn("new", F.lit(True)))
        merged = both.groupBy("src", "dst").agg(F.min("cost").alias("cost"), F.min(F.when(~F.col("new"), F.col("cost"))).alias("old"))
        merged = settled(merged)
        best = merged.select("src", "dst", "cost")
        active = merged.filter("old is null or cost < old").select("src", "dst", "cost")
        if active.isEmpty():
            return best
        if hop >= COUNTED:
            most = most or e.select("s").union(e.select("d")).distinct().count()
            if hop > most:
                raise ValueError("edges form a cycle of negative weight")


def packed(edges: DataFrame, direction: str = "out") -> DataFrame:
    """(id, neighbours): each node's sorted list of neighbours."""
    return oriented(edges, direction).groupBy(F.col("s").alias("id")).agg(F.sort_array(F.collect_list("d")).alias("neighbours"))


def probe_properties(paths: DataFrame, nodes: DataFrame, key: str, props: list[str]) -> DataFrame:
    """paths (src, dst, length, nodes, ...) with `properties`, the given properties of its nodes in order."""
    at = paths.select("src", "dst", "length", F.col("nodes").alias("_p"), F.posexplode("nodes").alias("_i", "_n"))
    found = at.join(nodes.select(F.col(key).alias("_k"), *props), F.col("_n") == F.col("_k"), "left")
    lists = found.groupBy("src", "dst", "length", "_p").agg(F.sort_array(F.collect_list(F.struct("_i", *props))).alias("_l"))
    return lists.select("src", "dst", "length", F.col("_p").alias("nodes"), F.transform("_l", lambda x: F.struct(*(x[p].alias(p) for p in props))).alias("properties"))
