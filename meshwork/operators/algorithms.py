"""Graph algorithms over edges (src, dst[, weight]) and vertices (id), as rounds of joins and aggregations.

Unless `directed` is set a graph is undirected. Parallel edges and self-loops count once or not at all, as each algorithm
says. State is written every round, so a lost executor costs no more than the round.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.plans.lineage import written as settled

inf = float("inf")


def simple(edges: DataFrame, directed: bool = False) -> DataFrame:
    """Distinct (src, dst) without self-loops; undirected ones in both directions."""
    e = edges.select("src", "dst").filter("src <> dst")
    return (e if directed else e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))).distinct()


def all_ids(edges: DataFrame, vertices: DataFrame | None) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id")))
    return (ends if vertices is None else ends.union(vertices.select("id"))).distinct()


def page_rank(edges: DataFrame, vertices: DataFrame | None = None, directed: bool = False, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(node_id, rank); ranks sum to 1, the mass of nodes without out-edges is spread evenly."""
    edges = settled(edges.select("src", "dst"))  # what makes the edges runs once
    ids = settled(all_ids(edges, vertices))
    n = ids.count()
    if not n:
        return ids.select(F.col("id").alias("node_id"), F.lit(0.0).alias("rank"))
    e = settled(simple(edges, directed))
    degree = e.groupBy(F.col("src").alias("s")).agg(F.count("*").alias("deg"))
    # a row for each node and, at hubs, for each 65,536 neighbours or so: rounds join and sort these, not the edges
    share = F.pmod(F.xxhash64("dst"), F.ceil(F.col("deg") / 65536)).alias("_share")
    e = settled(e.join(degree, F.col("src") == F.col("s")).groupBy("src", "deg", share).agg(F.collect_list("dst").alias("to")).select("src", "deg", "to"))
    ranks = settled(ids.join(degree, F.col("id") == F.col("s"), "left").select("id", F.coalesce("deg", F.lit(0)).alias("deg"), F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("old")))
    for _ in range(rounds):
        # one action a round: what dangles, and how far the last round moved
        dangling, moved = ranks.agg(F.coalesce(F.sum(F.when(F.col("deg") == 0, F.col("rank"))), F.lit(0.0)), F.sum(F.abs(F.col("rank") - F.col("old")))).first()
        if moved < tolerance:
            break
        sent = e.join(ranks.select("id", "rank"), F.col("src") == F.col("id")).select(F.explode("to").alias("d"), (F.col("rank") / F.col("deg")).alias("r")).groupBy("d").agg(F.sum("r").alias("got"))
        base = (1 - damping) / n + damping * dangling / n
        ranks = settled(ranks.join(sent, F.col("id") == F.col("d"), "left").select("id", "deg", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("new"), F.col("rank").alias("old")).withColumnRenamed("new", "rank"))
    return ranks.select(F.col("id").alias("node_id"), "rank")


def connected_components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(node_id, component_id): the smallest id of the component. Alternating stars: rounds logarithmic in practice."""
    ids = all_ids(edges, vertices)
    cur = settled(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct())
    sign = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = sign(cur)
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("w"))
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("w").alias("u"), F.col("m").alias("v")))
        cur = settled(small.filter("u <> v").distinct())
        after = sign(cur)
        if after == before:
            break
        before = after
    return ids.join(cur, F.col("id") == F.col("u"), "left").select(F.col("id").alias("node_id"), F.coalesce("v", "id").alias("component_id"))


def _spread_max(edges: DataFrame, state: DataFrame) -> DataFrame:
    """state (id, c) after c, a maximum, has gone along edges (src, dst) until nothing changes."""
    state = settled(state)
    while True:
        got = edges.join(state, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("d")).agg(F.max("c").alias("g"))
        new = settled(state.join(got, F.col("id") == F.col("d"), "left").select("id", F.greatest("c", F.coalesce("g", "c")).alias("c"), (F.col("g") > F.col("c")).alias("up")))
        done = new.filter("up").isEmpty()
        state = new.select("id", "c")
        if done:
            return state


def strong_components(edges: DataFrame, vertices: DataFrame | None = None, directed: bool = True) -> DataFrame:
    """(node_id, component_id): the smallest id of the strong component.

    Colouring: the largest id that reaches a node is its colour; of a colour, what reaches its root backwards within
    the colour is a component. Found components leave, rounds go on with the rest; nodes without both an in- and an
    out-edge leave alone first.
    """
    if not directed:
        return connected_components(edges, vertices)
    left = settled(all_ids(edges, vertices))
    e = settled(simple(edges, True))
    found: list[DataFrame] = []
    while not left.isEmpty():
        while True:  # trim
            inner = left.join(e.select(F.col("src").alias("id")), "id", "left_semi").join(e.select(F.col("dst").alias("id")), "id", "left_semi")
            inner = settled(inner)
            alone = settled(left.join(inner, "id", "left_anti"))
            if alone.isEmpty():
                break
            found.append(alone.select("id", F.col("id").alias("root")))
            left = inner
            e = settled(e.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"))
        if left.isEmpty():
            break
        colour = _spread_max(e, left.select("id", F.col("id").alias("c")))
        a, b = colour.select(F.col("id").alias("src"), F.col("c").alias("ca")), colour.select(F.col("id").alias("dst"), F.col("c").alias("cb"))
        within = settled(e.join(a, "src").join(b, "dst").filter("ca = cb").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("ca").alias("w")))
        mark = settled(colour.filter("id = c").select("id", "c"))
        frontier = mark
        while True:
            step = frontier.join(within, (F.col("id") == F.col("src")) & (F.col("c") == F.col("w"))).select(F.col("dst").alias("id"), "c").distinct()
            frontier = settled(step.join(mark, "id", "left_anti"))
            if frontier.isEmpty():
                break
            mark = settled(mark.unionByName(frontier))
        found.append(mark.select("id", F.col("c").alias("root")))
        left = settled(left.join(mark, "id", "left_anti"))
        e = settled(e.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    if not found:
        return edges.select(F.col("src").alias("node_id"), F.col("src").alias("component_id")).limit(0)
    out = reduce(DataFrame.unionByName, found)
    least = out.groupBy("root").agg(F.min("id").alias("component_id"))
    return out.join(least, "root").select(F.col("id").alias("node_id"), "component_id")


def k_core(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(node_id, core_number) by peeling: at k, nodes of degree at most k leave until all have more."""
    e = settled(simple(edges))
    left = settled(all_ids(edges, vertices))
    out: list[DataFrame] = []
    k = 0
    while not left.isEmpty():
        degree = e.groupBy(F.col("src").alias("s")).agg(F.count("*").alias("deg"))
        state = settled(left.join(degree, F.col("id") == F.col("s"), "left").select("id", F.coalesce("deg", F.lit(0)).alias("deg")))
        least = state.agg(F.min("deg")).first()[0]
        k = max(k, least)
        gone = state.filter(F.col("deg") <= k).select("id")
        out.append(gone.select(F.col("id").alias("node_id"), F.lit(k).cast("long").alias("core_number")))
        left = settled(state.filter(F.col("deg") > k).select("id"))
        e = settled(e.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    return reduce(DataFrame.unionByName, out) if out else left.select(F.col("id").alias("node_id"), F.lit(0).cast("long").alias("core_number"))


def label_propagation(edges: DataFrame, vertices: DataFrame | None = None, rounds: int = 10) -> DataFrame:
    """(node_id, label): all at once, each node takes its neighbours' most frequent label, the larger of equals."""
    e = settled(simple(edges))
    state = settled(all_ids(edges, vertices).select("id", F.col("id").alias("label")))
    for _ in range(rounds):
        votes = e.join(state, F.col("dst") == F.col("id")).groupBy("src", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("src").agg(F.max(F.struct("n", "label")).alias("b"))
        new = settled(state.join(best, F.col("id") == F.col("src"), "left").select("id", F.coalesce("b.label", "label").alias("label"), F.col("label").alias("old")))
        done = new.filter("label <> old").isEmpty()
        state = new.select("id", "label")
        if done:
            break
    return state.select(F.col("id").alias("node_id"), "label")


def triangles(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(node_id, triangles). Edges point from the lower to the higher degree, so hubs have few out-edges to pair."""
    edges = settled(edges.select("src", "dst"))  # what makes the edges runs once
    both = settled(simple(edges))
    degree = both.groupBy("src").agg(F.count("*").alias("deg"))
    a, b = degree.select(F.col("src"), F.col("deg").alias("da")), degree.select(F.col("src").alias("dst"), F.col("deg").alias("db"))
    e = settled(both.join(a, "src").join(b, "dst").filter("da < db or (da = db and src < dst)").select("src", "dst", "db"))
    # the edge that closes a wedge points the same way, so each pair is made in that order alone
    x, y = (e.select("src", F.col("dst").alias(c), F.col("db").alias(f"d{c}")) for c in "xy")
    wedge = x.join(y, "src").filter("dx < dy or (dx = dy and x < y)").select("src", "x", "y")
    closed = wedge.join(e.select(F.col("src").alias("x"), F.col("dst").alias("y")), ["x", "y"])
    corners = closed.select(F.explode(F.array("src", "x", "y")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return all_ids(edges, vertices).join(corners, "id", "left").select(F.col("id").alias("node_id"), F.coalesce("n", F.lit(0)).cast("long").alias("triangles"))


def distances(edges: DataFrame, sources: DataFrame, directed: bool = False, hops: int | None = None) -> DataFrame:
    """(src, dst, distance, paths): breadth-first from every source, with the number of shortest paths; to all that is
    within reach unless hops is given."""
    e = settled(simple(edges, directed).select(F.col("src").alias("s"), F.col("dst").alias("d")))
    seen = settled(sources.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).cast("long").alias("distance"), F.lit(1.0).alias("paths")).distinct())
    frontier = seen
    for hop in count(1) if hops is None else range(1, hops + 1):
        step = frontier.join(e, F.col("dst") == F.col("s")).groupBy("src", F.col("d").alias("dst")).agg(F.sum("paths").alias("paths"))
        frontier = settled(step.join(seen, ["src", "dst"], "left_anti").select("src", "dst", F.lit(hop).cast("long").alias("distance"), "paths"))
        if frontier.isEmpty():
            break
        seen = settled(seen.unionByName(frontier))
    return seen


def shortest_path(edges: DataFrame, source, directed: bool = False, hops: int = 100) -> DataFrame:
    """(src, dst, distance) from one node, within 100 hops by default."""
    one = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).filter(F.col("id") == F.lit(source)).distinct()
    return distances(edges, one, directed, hops).select("src", "dst", "distance")


def weighted_shortest_path(edges: DataFrame, source, directed: bool = False) -> DataFrame:
    """(src, dst, cost) from one node by the weight column."""
    from meshwork.operators.traverse import cheapest

    e = edges.select("src", "dst", "weight")
    if not directed:
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    one = e.select(F.col("src").alias("id")).filter(F.col("id") == F.lit(source)).distinct()
    return cheapest(one, e)


def reachable_counts(edges: DataFrame, vertices: DataFrame | None = None, directed: bool = False) -> DataFrame:
    """(node_id, reachable): nodes within reach, itself not counted; by component sizes where undirected."""
    if not directed:
        c = settled(connected_components(edges, vertices))
        n = c.groupBy("component_id").agg((F.count("*") - 1).alias("reachable"))
        return c.join(n, "component_id").select("node_id", "reachable")
    ids = all_ids(edges, vertices)
    d = distances(edges, ids, True).filter("distance > 0").groupBy(F.col("src").alias("s")).agg(F.count("*").alias("n"))
    return ids.join(d, F.col("id") == F.col("s"), "left").select(F.col("id").alias("node_id"), F.coalesce("n", F.lit(0)).alias("reachable"))


def closeness(edges: DataFrame, vertices: DataFrame | None = None, directed: bool = False) -> DataFrame:
    """(node_id, centrality): Wasserman-Faust, (r / (n - 1))**2 * (r / sum of distances) over r reachable others."""
    ids = settled(all_ids(edges, vertices))
    n = ids.count()
    d = distances(edges, ids, directed).filter("distance > 0").groupBy(F.col("src").alias("s")).agg(F.count("*").alias("r"), F.sum("distance").alias("t"))
    share = F.col("r") / F.lit(max(1, n - 1))
    return ids.join(d, F.col("id") == F.col("s"), "left").select(F.col("id").alias("node_id"), F.when(F.col("r") > 0, share * share * F.col("r") / F.col("t")).otherwise(F.lit(0.0)).alias("centrality"))


def betweenness(edges: DataFrame, vertices: DataFrame | None = None, directed: bool = False) -> DataFrame:
    """(node_id, centrality): Brandes from all nodes at once, by levels; halved where undirected."""
    ids = settled(all_ids(edges, vertices))
    e = settled(simple(edges, directed).select(F.col("src").alias("s"), F.col("dst").alias("d")))
    dist = settled(distances(edges, ids, directed))
    deepest = dist.agg(F.max("distance")).first()[0] or 0
    level = lambda k: dist.filter(F.col("distance") == k)
    out = None
    below = None
    for k in range(deepest, 0, -1):
        here = level(k).select("src", F.col("dst").alias("w"), F.col("paths").alias("pw"))
        here = here.withColumn("delta", F.lit(0.0)) if below is None else here.join(below, ["src", "w"], "left").withColumn("delta", F.coalesce("g", F.lit(0.0))).drop("g")
        here = settled(here)
        gain = here.select(F.col("w").alias("id"), F.col("delta").alias("x"))
        out = gain if out is None else out.unionByName(gain)
        up = level(k - 1).select("src", F.col("dst").alias("v"), F.col("paths").alias("pv"))
        flow = here.join(e, F.col("w") == F.col("d")).join(up, ["src"]).filter("s = v")
        below = flow.groupBy("src", "v").agg(F.sum(F.col("pv") / F.col("pw") * (1 + F.col("delta"))).alias("g")).withColumnRenamed("v", "w")
    if out is None:
        return ids.select(F.col("id").alias("node_id"), F.lit(0.0).alias("centrality"))
    total = out.groupBy(F.col("id").alias("i")).agg(F.sum("x").alias("x"))
    return ids.join(total, F.col("id") == F.col("i"), "left").select(F.col("id").alias("node_id"), (F.coalesce("x", F.lit(0.0)) / (1 if directed else 2)).alias("centrality"))


def degrees(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(node_id, degree): distinct neighbours."""
    d = simple(edges).groupBy(F.col("src").alias("s")).agg(F.count("*").alias("n"))
    return all_ids(edges, vertices).join(d, F.col("id") == F.col("s"), "left").select(F.col("id").alias("node_id"), F.coalesce("n", F.lit(0)).alias("degree"))


def spanning_forest(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(node_id, parent_id): each component's breadth-first tree from its smallest id; roots are their own parents."""
    c = settled(connected_components(edges, vertices))
    e = settled(simple(edges))
    tree = settled(c.filter("node_id = component_id").select("node_id", F.col("node_id").alias("parent_id")))
    frontier = tree
    while True:
        step = frontier.join(e, F.col("node_id") == F.col("src")).groupBy(F.col("dst").alias("n")).agg(F.min("src").alias("p"))
        frontier = settled(step.join(tree.select(F.col("node_id").alias("n")), "n", "left_anti").select(F.col("n").alias("node_id"), F.col("p").alias("parent_id")))
        if frontier.isEmpty():
            return tree
        tree = settled(tree.unionByName(frontier))


def spread_activation(edges: DataFrame, seeds: list, decay: float = 0.5, threshold: float = 0.01, hops: int = 3, directed: bool = False) -> DataFrame:
    """(node_id, activation, hop): what seeds pass on, weight times decay a hop; small sums and earlier nodes drop out."""
    frame = edges.sparkSession.createDataFrame([(s,) for s in seeds], f"id {edges.schema['src'].dataType.simpleString()}")
    out = batch_spread(edges, frame, decay, threshold, hops, None, directed, True)
    return out.groupBy("node_id").agg(F.sum("activation").alias("activation"), F.min("hop").alias("hop"))


def batch_spread(edges: DataFrame, seeds: DataFrame, decay: float = 0.5, threshold: float = 0.01, hops: int = 3, most: int | None = None, directed: bool = False, keep_seeds: bool = False) -> DataFrame:
    """(seed, node_id, activation, hop) for each seed on its own; `most` keeps that many per seed."""
    from pyspark.sql import Window as W

    e = edges.select("src", "dst", "weight").filter("src <> dst")
    if not directed:
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    e = settled(e.groupBy("src", "dst").agg(F.max("weight").alias("weight")))
    seen = settled(seeds.select(F.col("id").alias("seed"), F.col("id").alias("node_id"), F.lit(1.0).alias("activation"), F.lit(0).alias("hop")).distinct())
    frontier = seen
    for hop in range(1, hops + 1):
        step = frontier.join(e, F.col("node_id") == F.col("src")).groupBy("seed", "dst").agg(F.sum(F.col("activation") * F.col("weight") * decay).alias("activation"))
        step = step.filter(F.col("activation") >= threshold).withColumnRenamed("dst", "node_id").join(seen, ["seed", "node_id"], "left_anti")
        frontier = settled(step.select("seed", "node_id", "activation", F.lit(hop).alias("hop")))
        if frontier.isEmpty():
            break
        seen = settled(seen.unionByName(frontier))
    out = seen if keep_seeds else seen.filter("hop > 0")
    if most is not None:
        out = out.withColumn("_r", F.row_number().over(W.partitionBy("seed").orderBy(F.desc("activation"), "node_id"))).filter(F.col("_r") <= most).drop("_r")
    return out


def louvain(edges: DataFrame, vertices: DataFrame | None = None, least_gain: float = 0.001, rounds: int = 20) -> DataFrame:
    """(node_id, community_id, modularity): local moves all at once, then communities become nodes, while it pays.

    In odd rounds nodes move only to smaller community ids, in even ones only to larger, so that pairs don't swap.
    """
    ids = all_ids(edges, vertices)
    w = "weight" if "weight" in edges.columns else None
    e = edges.select("src", "dst", (F.col(w) if w else F.lit(1.0)).alias("w")).filter("src <> dst")
    e = settled(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.max("w").alias("w")))
    total = e.agg(F.sum("w")).first()[0] or 0.0
    member = settled(ids.select("id", F.col("id").alias("c")))
    if not total:
        return member.select(F.col("id").alias("node_id"), F.col("c").alias("community_id"), F.lit(0.0).alias("modularity"))

    def modularity(m: DataFrame, g: DataFrame) -> float:
        a, b = m.select(F.col("id").alias("src"), F.col("c").alias("ca")), m.select(F.col("id").alias("dst"), F.col("c").alias("cb"))
        x = g.join(a, "src").join(b, "dst")
        inside = x.agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")))).first()[0] or 0.0
        square = x.groupBy("ca").agg(F.sum("w").alias("k")).agg(F.sum((F.col("k") / total) ** 2)).first()[0]
        return inside / total - square

    graph, best = e, modularity(member, e)
    while True:
        nodes = graph.select(F.col("src").alias("id")).union(graph.select(F.col("dst").alias("id"))).distinct()
        part = settled(nodes.select("id", F.col("id").alias("c")))
        strength = settled(graph.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")))
        inner = best
        for r in range(rounds):
            sums = part.join(strength, "id").groupBy(F.col("c").alias("cc")).agg(F.sum("k").alias("tot"))
            near = graph.filter("src <> dst").join(part.select(F.col("id").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("id"), F.col("c").alias("cc")).agg(F.sum("w").alias("kin"))
            own = part.join(strength, "id")
            x = near.join(own, "id").join(sums, "cc")
            score = F.col("kin") - F.col("k") * (F.col("tot") - F.when(F.col("cc") == F.col("c"), F.col("k")).otherwise(0.0)) / total
            x = x.withColumn("s", score)
            stay = x.filter("cc = c").select("id", F.col("s").alias("s0"))
            alone = own.join(sums, F.col("c") == F.col("cc")).select("id", (-F.col("k") * (F.col("tot") - F.col("k")) / total).alias("sa"))
            way = F.col("cc") < F.col("c") if r % 2 == 0 else F.col("cc") > F.col("c")
            go = x.filter(way).join(stay, "id", "left").join(alone, "id", "left").filter(F.col("s") > F.coalesce("s0", "sa") + 1e-12)
            go = go.groupBy("id").agg(F.max(F.struct("s", "cc")).alias("b")).select(F.col("id").alias("i"), F.col("b.cc").alias("to"))
            new = settled(part.join(go, F.col("id") == F.col("i"), "left").select("id", F.coalesce("to", "c").alias("c")))
            q = modularity(new, graph)
            if q <= inner + 1e-9 and r > 0:
                break
            if q > inner:
                part, inner = new, q
        if inner <= best + least_gain:
            break
        best = inner
        member = settled(member.join(part.select(F.col("id").alias("i"), F.col("c").alias("n")), F.col("c") == F.col("i"), "left").select("id", F.coalesce("n", "c").alias("c")))
        a, b = part.select(F.col("id").alias("src"), F.col("c").alias("ca")), part.select(F.col("id").alias("dst"), F.col("c").alias("cb"))
        graph = settled(graph.join(a, "src").join(b, "dst").groupBy(F.col("ca").alias("src"), F.col("cb").alias("dst")).agg(F.sum("w").alias("w")))
    least = member.groupBy("c").agg(F.min("id").alias("community_id"))
    return member.join(least, "c").select(F.col("id").alias("node_id"), "community_id", F.lit(best).alias("modularity"))


def walks(edges: DataFrame, vertices: DataFrame | None = None, steps: int = 5, per_node: int = 2, p: float = 1.0, q: float = 1.0, seed: int = 42) -> DataFrame:
    """(start, walk, step, node): seeded walks; each step's choice is a hash of walk and step, so reruns agree.

    p and q weigh returning and going outwards as in node2vec; 1 and 1 is a uniform walk.
    """
    e = settled(simple(edges))
    start = all_ids(edges, vertices).withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))))
    at = settled(start.select(F.col("id").alias("start"), "walk", F.lit(0).alias("step"), F.col("id").alias("node"), F.col("id").alias("prev")))
    trail = [at]
    for step in range(1, steps + 1):
        u = (F.pmod(F.xxhash64("start", "walk", "dst", F.lit(step), F.lit(seed)), F.lit(1 << 40)) + 1) / float(1 << 40)
        x = at.join(e, F.col("node") == F.col("src"))
        if p == q == 1.0:
            weight = F.lit(1.0)
        else:
            back = e.select(F.col("src").alias("s2"), F.col("dst").alias("d2"))
            x = x.join(back, (F.col("prev") == F.col("s2")) & (F.col("dst") == F.col("d2")), "left")
            weight = F.when(F.col("dst") == F.col("prev"), 1 / p).when(F.col("s2").isNotNull(), 1.0).otherwise(1 / q)
        # the smallest exponential key wins: a draw in proportion to the weights without ordering neighbours
        pick = x.groupBy("start", "walk", "node").agg(F.min(F.struct((-F.log(u) / weight).alias("k"), F.col("dst"))).alias("b"))
        at = settled(pick.select("start", "walk", F.lit(step).alias("step"), F.col("b.dst").alias("node"), F.col("node").alias("prev")))
        trail.append(at)
    return reduce(DataFrame.unionByName, trail).select("start", "walk", "step", "node")


def random_walk(edges: DataFrame, vertices: DataFrame | None = None, steps: int = 5, per_node: int = 2) -> DataFrame:
    """(node_id, hit_count): visits by all walks, starts included."""
    return walks(edges, vertices, steps, per_node).groupBy(F.col("node").alias("node_id")).agg(F.count("*").alias("hit_count"))


def node2vec(edges: DataFrame, vertices: DataFrame | None = None, p: float = 1.0, q: float = 1.0, dimensions: int = 4, per_node: int = 3, window: int = 5, steps: int = 10) -> DataFrame:
    """(node_id, dim_0, ...): skip-gram vectors of biased walks."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    w = walks(edges, vertices, steps, per_node, p, q)
    lines = w.groupBy("start", "walk").agg(F.sort_array(F.collect_list(F.struct("step", F.col("node").cast("string").alias("n")))).alias("l")).select(F.col("l.n").alias("words"))
    model = Word2Vec(vectorSize=dimensions, windowSize=window, minCount=0, seed=42, inputCol="words", outputCol="v").fit(lines)
    v = model.getVectors().select("word", vector_to_array("vector").alias("a"))
    kind = edges.schema["src"].dataType.simpleString()
    return v.select(F.col("word").cast(kind).alias("node_id"), *[F.col("a")[i].alias(f"dim_{i}") for i in range(dimensions)])
