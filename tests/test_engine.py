"""The engine on a small graph: parsing, patterns, aggregates, updates, algorithms."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshwork.engine import Engine
from meshwork.functions.text_search import stem_word
from meshwork.operators import algorithms, search
from meshwork.plans.parser import ParseError, parse
from meshwork.queries import QUERIES, graph


@pytest.fixture
def g(spark):
    e = Engine(spark)
    e.node_table("P", "id", spark.createDataFrame([(i, f"p{i}", i * 10 if i < 6 else None) for i in range(8)], "id long, name string, age long"))
    e.rel_table("K", "P", "P", spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 3), (0, 1), (4, 5)], "_src long, _dst long"))
    return e


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_match_counts_parallel_edges(g):
    assert rows(g.cypher("MATCH (a:P {id: 0})-[:K]->(b:P) RETURN b.id AS b")) == [(1,), (1,)]


def test_both_directions_count_a_loop_twice(g):
    assert rows(g.cypher("MATCH (a:P {id: 3})-[:K]-(b:P) RETURN b.id AS b")) == [(2,), (3,), (3,)]


def test_null_comparisons_and_order(g):
    assert rows(g.cypher("MATCH (a:P) WHERE a.age > 30 RETURN a.id AS a")) == [(4,), (5,)]
    ordered = [r["a"] for r in g.cypher("MATCH (a:P) RETURN a.id AS a ORDER BY a.age DESC, a LIMIT 3").collect()]
    assert ordered == [6, 7, 5]


def test_optional_match_and_exists(g):
    assert rows(g.cypher("MATCH (a:P) OPTIONAL MATCH (a)-[:K]->(b:P) WHERE b.id > 2 WITH a, b WHERE a.id > 2 RETURN a.id AS a, coalesce(b.id, -1) AS b")) == [(3, 3), (4, 5), (5, -1), (6, -1), (7, -1)]
    assert rows(g.cypher("MATCH (a:P) WHERE NOT EXISTS { MATCH (a)-[:K]-(b:P) } RETURN a.id AS a")) == [(6,), (7,)]
    assert rows(g.cypher("MATCH (a:P) WHERE a.id = 7 OR EXISTS { MATCH (a)-[:K]->(b:P) WHERE b.id = 5 } RETURN a.id AS a")) == [(4,), (7,)]


def test_reach_is_one_row_per_node_at_its_distance(g):
    assert rows(g.cypher("MATCH (a:P {id: 0})-[p:K*1..5]->(b:P) RETURN b.id AS b, length(p) AS n")) == [(1, 1), (2, 2), (3, 3)]


def test_implicit_grouping_keeps_all_keys(g):
    assert rows(g.cypher("MATCH (a:P)-[:K]->(b:P) WITH a, COUNT(*) AS n WHERE n > 1 RETURN a.name AS name, n AS n")) == [("p0", 2), ("p2", 2)]
    assert rows(g.cypher("MATCH (a:P) WHERE a.id < 0 RETURN COUNT(*) AS n, SUM(a.age) AS s")) == [(0, None)]


def test_updates_make_new_versions(g):
    g.cypher("CREATE (:P {id: 9, name: 'new'})")
    with pytest.raises(ValueError):
        g.cypher("CREATE (:P {id: 9})")
    g.cypher("MATCH (a:P {id: 9}) SET a.age = 1")
    assert rows(g.cypher("MATCH (a:P {id: 9}) RETURN a.name AS n, a.age AS a")) == [("new", 1)]
    with pytest.raises(ValueError):
        g.cypher("MATCH (a:P {id: 3}) DELETE a")
    g.cypher("MATCH (a:P {id: 3}) DETACH DELETE a")
    assert rows(g.cypher("MATCH (:P)-[:K]->(b:P) RETURN b.id AS b")) == [(0,), (1,), (1,), (2,), (5,)]
    g.cypher("MERGE (a:P {id: 9}) ON MATCH SET a.name = 'met'")
    assert rows(g.cypher("MATCH (a:P {id: 9}) RETURN a.name AS n")) == [("met",)]


def joined_rows(df):
    """The most rows that an operator of df's plan made."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    most, left = 0, [plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan]
    while left:
        x = left.pop()
        if x.getClass().getSimpleName().endswith("QueryStageExec"):
            left.append(x.plan())
        m = x.metrics().get("numOutputRows")
        most = max(most, m.get().value()) if m.isDefined() else most
        left += [x.children().apply(i) for i in range(x.children().size())]
    return most


@pytest.fixture
def star(spark):
    """One hub H 0 under 300 of A and 200 of B; A 7 is also under H 1."""
    e = Engine(spark)
    e.node_table("H", "id", spark.createDataFrame([(0, "x"), (1, "y")], "id long, name string"))
    e.node_table("R", "id", spark.createDataFrame([(5, "r")], "id long, name string"))
    for label, n in (("A", 300), ("B", 200)):
        e.node_table(label, "id", spark.range(n).selectExpr("id", "id % 10 AS size"))
        e.rel_table(f"{label}H", label, "H", spark.range(n).selectExpr("id AS _src", "0L AS _dst").union(spark.createDataFrame([(7, 1)], "_src long, _dst long")))
    e.rel_table("HR", "H", "R", spark.createDataFrame([(0, 5), (1, 5)], "_src long, _dst long"))
    return e


def test_branches_of_a_hub_are_counted_before_they_meet(star):
    got = star.cypher("MATCH (h:H)<-[:AH]-(a:A), (h)<-[:BH]-(b:B), (h)-[:HR]->(r:R) WHERE a.size > 4 RETURN h.name AS h, r.name AS r, COUNT(*) AS n")
    assert rows(got) == [("x", "r", 150 * 200), ("y", "r", 1)] and joined_rows(got) < 1000


@pytest.mark.parametrize(("text", "expected"), [
    ("MATCH (a:A)-[:AH]->(h:H)<-[:BH]-(:B) RETURN COUNT(*) AS n", [(60001,)]),
    ("MATCH (a:A)-[:AH]->(:H)<-[:BH]-(b:B {size: 3}) WHERE a.id < 2 RETURN a.id AS a, COUNT(*) + 1 AS n", [(0, 21), (1, 21)]),
    ("MATCH (r:R)<-[:HR]-(h:H)<-[:AH]-(a:A), (h)<-[e:BH]-(b:B) WHERE e._src < 10 AND a.id >= 0 RETURN r.id AS r, COUNT(*) AS n ORDER BY COUNT(*)", [(5, 3001)]),
    ("MATCH (a:A)-[:AH]->(h:H)<-[:BH]-(b:B) WHERE a.id = b.id RETURN h.id AS h, COUNT(*) AS n", [(0, 200), (1, 1)]),
    ("MATCH (a:A)-[:AH]->(h:H)<-[:BH]-(b:B) WHERE a.id < 0 RETURN COUNT(*) AS n", [(0,)]),
    ("MATCH (a:A)-[:AH]->(h:H)<-[:BH]-(b:B) WHERE h.id = 0 WITH h, COUNT(*) AS n MATCH (h)-[:HR]->(r:R) RETURN h.name AS h, r.name AS r, n AS n", [("x", "r", 60000)]),
])
def test_counts_over_branches(star, text, expected):
    assert rows(star.cypher(text)) == expected


@pytest.fixture(scope="module")
def lands(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("lands"))
    spark.createDataFrame([(0, "A", 0), (1, "B", 1), (2, "C", 1)], "n_nationkey long, n_name string, n_regionkey long").write.parquet(f"{at}/nation.parquet")
    spark.createDataFrame([(0, "EAST"), (1, "WEST")], "r_regionkey long, r_name string").write.parquet(f"{at}/region.parquet")
    spark.createDataFrame([(0, 0)], "c_custkey long, c_nationkey long").write.parquet(f"{at}/customer.parquet")
    spark.createDataFrame([(0, 0)], "s_suppkey long, s_nationkey long").write.parquet(f"{at}/supplier.parquet")
    return at


IN_REGION = [("A", "EAST"), ("B", "WEST"), ("C", "WEST")]


def test_a_created_edge_stands_once(spark, lands):
    assert rows(QUERIES["create"][0](spark, lands)) == sorted([*IN_REGION, ("NEWLAND", "NORTH")])


@pytest.mark.parametrize("text", ["CREATE (:Nation {n_nationkey: 9, n_name: 'D', n_regionkey: 1})", "MATCH (n:Nation {n_nationkey: 0}) SET n.n_regionkey = 1", "ALTER TABLE Nation DROP n_regionkey", "ALTER TABLE Nation RENAME TO Land"])
def test_changes_of_nodes_leave_edges_that_no_query_used_yet(spark, lands, text):
    g = graph(spark, lands)
    g.cypher(text)
    label = "Land" if "Land" in text else "Nation"
    assert rows(g.cypher(f"MATCH (n:{label})-[:IN_REGION]->(r:Region) RETURN n.n_name AS n, r.r_name AS r")) == IN_REGION


def test_rollback_takes_back_edges_first_used_in_between(spark, lands):
    g = graph(spark, lands)
    query = "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_name AS n, r.r_name AS r"
    for text in ("BEGIN TRANSACTION", "MATCH (n:Nation {n_nationkey: 0}) SET n.n_regionkey = 1", query, "ROLLBACK"):
        g.cypher(text)
    assert rows(g.cypher(query)) == IN_REGION


def test_components_triangles_and_ranks(g):
    edges, vertices = g.graph()
    assert rows(algorithms.connected_components(edges, vertices)) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 4), (5, 4), (6, 6), (7, 7)]
    assert rows(algorithms.strong_components(edges, vertices)) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7)]
    assert rows(algorithms.triangles(edges, vertices)) == [(0, 1), (1, 1), (2, 1), (3, 0), (4, 0), (5, 0), (6, 0), (7, 0)]
    ranks = dict(rows(algorithms.page_rank(edges, vertices)))
    assert abs(sum(ranks.values()) - 1) < 1e-6 and ranks[2] > ranks[0] > ranks[3] > ranks[6]


def counted_edges(spark, calls):
    """Six edges of a triangle, a tail and a pair; each run of what makes them adds to calls."""
    made = F.udf(lambda x: calls.add(1) or x, "long").asNondeterministic()
    return spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (4, 5), (3, 3)], "src long, dst long").select(made("src").alias("src"), "dst")


@pytest.mark.parametrize("algorithm", [algorithms.page_rank, algorithms.triangles])
def test_what_makes_the_edges_runs_once(spark, algorithm):
    calls = spark.sparkContext.accumulator(0)
    assert algorithm(counted_edges(spark, calls)).count() == 6 and calls.value == 6


def test_empty_and_clashing_names(spark):
    e = Engine(spark)
    e.node_table("N", "id", spark.createDataFrame([], "id long, _src long, score double"))
    assert e.cypher("MATCH (a:N) RETURN a.id AS id, a._src AS s").collect() == []


@pytest.mark.parametrize("text", ["MATCH (a:P RETURN a", "RETURN", "MATCH (a) WHERE RETURN a", "CREATE NODE TABLE X(a INT64)"])
def test_faulty_texts(text):
    with pytest.raises(ParseError):
        parse(text)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_parser_gives_errors_of_its_own(text):
    try:
        parse(text)
    except ParseError:
        pass


def test_stems():
    """Examples of the published description."""
    pairs = "caresses caress ponies poni cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope sensibiliti sensibl triplicate triplic formative form formalize formal electrical electr goodness good revival reviv allowance allow adjustable adjust irritant irrit replacement replac dependent depend adoption adopt communism commun activate activ effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll".split()
    assert [stem_word(w) for w in pairs[::2]] == pairs[1::2]
    assert [stem_word(w) for w in ("is", "", None, "don't")] == ["is", "", None, "don't"]


def test_windows_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    import datetime as dt

    from meshwork.streaming import windows

    at = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(i, at + dt.timedelta(minutes=17 * i), i % 3, "ab"[i % 2]) for i in range(40)], "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    batch = windows.tumbling(spark.read.parquet(f"{tmp_path}/events.parquet"), "ts", "1 hour", ["event_type"])
    assert rows(windows.streamed(spark, str(tmp_path)).select("start", "event_type", "n")) == rows(batch)


@pytest.mark.parametrize("name", ["weighted", "closeness", "betweenness"])
def test_paths_of_over_100_edges(spark, name):
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        line = spark.createDataFrame([(i, i + 1, 1.0) for i in range(102)], "src long, dst long, weight double").coalesce(1)
        if name == "weighted":
            assert {r["dst"]: r["cost"] for r in algorithms.weighted_shortest_path(line, 0, directed=True).collect()} == {i: float(i) for i in range(103)}
        elif name == "closeness":
            got = {r["node_id"]: r["centrality"] for r in algorithms.closeness(line, directed=True).collect()}
            assert got[0] == pytest.approx(102 / sum(range(103)))
        else:
            got = {r["node_id"]: r["centrality"] for r in algorithms.betweenness(line, directed=True).collect()}
            assert got == {i: i * (102 - i) for i in range(103)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_trails_tell_parallel_edges_apart(g):
    """0 -> 1 twice, then 1 -> 2 -> 0: both edges may be on one trail, and each begins one."""
    got = rows(g.cypher("MATCH (a:P {id: 0})-[p:K*TRAIL 1..4]->(b:P {id: 1}) RETURN length(p) AS n"))
    assert got == [(1,), (1,), (4,), (4,)]


def test_ranks_and_numbers_run_through(g, spark):
    from meshwork.operators import search

    df = spark.createDataFrame([(i, float(i * 7 % 50)) for i in range(200)], "id long, score double").repartition(7)
    got = rows(search.ranked(df))
    assert got == sorted((i, r + 1) for r, i in enumerate(sorted(range(200), key=lambda i: (-(i * 7 % 50), i))))
    assert "SinglePartition" not in search.ranked(df)._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["no"] for r in g.numbered(df, "no", 5).collect()) == list(range(5, 205))


def test_full_text_index_follows_updates(g):
    g.cypher("CREATE FTS INDEX names ON (P.name)")
    find = lambda q: rows(g.cypher(f"MATCH (a:P) USING FTS INDEX names('{q}') RETURN a.id AS id"))
    assert find("p3") == [(3,)] and find("walking") == []
    g.cypher("CREATE (:P {id: 20, name: 'walks of p3'})")
    assert find("p3") == [(3,), (20,)] and find("walking") == [(20,)]
    g.cypher("MATCH (a:P {id: 20}) SET a.name = 'sits'")
    assert find("p3") == [(3,)]


@pytest.mark.parametrize("b", [0.0, 0.75])
def test_bm25_without_an_index_makes_no_row_per_word(spark, b):
    texts = ["Licensed under licenses, licensing a license", "under the sun", "the of and", "", None, "License's sun " * 50, "under " * 3, "the license"]
    docs = spark.createDataFrame(list(enumerate([*texts, *["sun moon"] * 90])), "id long, text string").union(spark.createDataFrame([(1, "license")], "id long, text string"))
    expected = {k: round(v, 9) for k, v in search.bm25(search.postings(docs, "id", "text"), "under the license", b=b).collect()}
    got = search.bm25_scan(docs, "id", "text", "under the license", b=b)
    assert {k: round(v, 9) for k, v in got.collect()} == expected and set(expected) == {0, 1, 7}
    assert joined_rows(got) <= 98
    assert search.bm25_scan(docs, "id", "text", "the of", b=b).collect() == []


def test_hybrid_search_scans_texts_without_postings(spark, monkeypatch):
    monkeypatch.delattr(search, "postings")
    assert len(QUERIES["hybrid_search"][0](spark, "/root/testdata/sf0.001").collect()) == 10


def test_louvain_finds_cliques(spark):
    edges = [(a, b) for k in (0, 10) for a in range(k, k + 4) for b in range(a + 1, k + 4)] + [(3, 10)]
    got = algorithms.louvain(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r["node_id"]: r["community_id"] for r in got} == {k + i: k for k in (0, 10) for i in range(4)}
    inside, strength = 24 / 26, 13 / 26  # ends of edges within communities, and each one's share of all ends
    assert got[0]["modularity"] == pytest.approx(inside - 2 * strength**2)
