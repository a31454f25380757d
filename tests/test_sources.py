"""Sources on generated files: arrays, databases, dumps, exports."""

import sqlite3

import duckdb
import numpy as np
import pytest

from meshwork.engine import Engine
from meshwork.sources import databases, files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_npy(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    got = Engine(spark).load(f"{tmp_path}/a.npy", {})
    assert [(r["row"], list(r["values"])) for r in got.orderBy("row").collect()] == [(0, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [4.0, 5.0])]


def test_duckdb_and_sqlite(spark, tmp_path):
    with duckdb.connect(f"{tmp_path}/d.db") as c:
        c.sql("CREATE TABLE t AS SELECT * FROM (VALUES (1, 'a'), (2, NULL)) v(id, name)")
    with sqlite3.connect(f"{tmp_path}/s.db") as c:
        c.execute("CREATE TABLE t (id INTEGER, name TEXT)")
        c.executemany("INSERT INTO t VALUES (?, ?)", [(1, "a"), (2, None)])
    g = Engine(spark)
    for kind, path in (("duckdb", "d.db"), ("sqlite", "s.db")):
        assert g.cypher(f"CALL {kind}_scan('t', '{tmp_path}/{path}') RETURN id AS id, name AS name ORDER BY id").collect() == [(1, "a"), (2, None)]
        assert rows(g.cypher(f"CALL {kind}_query('SELECT count(*) AS n FROM t', '{tmp_path}/{path}') RETURN n AS n")) == [(2,)]


def test_dump_of_create_statements(spark, tmp_path):
    (tmp_path / "dump.cypher").write_text("CREATE (a:City {id: 1, name: 'A'});\nCREATE (b:City {id: 2, name: 'B'});\nMATCH (a:City {id: 1}), (b:City {id: 2}) CREATE (a)-[:NEAR {km: 5}]->(b);\n")
    g = Engine(spark)
    g.cypher(f"CALL neo4j_migrate('{tmp_path}/dump.cypher') RETURN message AS message")
    assert rows(g.cypher("MATCH (a:City)-[e:NEAR]->(b:City) RETURN a.name AS a, b.name AS b, e.km AS km")) == [("A", "B", 5)]


def test_attached_export(spark, tmp_path):
    g = Engine(spark)
    g.node_table("N", "id", spark.createDataFrame([(1, "x")], "id long, name string"))
    g.cypher(f"EXPORT DATABASE '{tmp_path}/out'")
    other = Engine(spark)
    other.cypher(f"ATTACH '{tmp_path}/out' AS one")
    assert rows(other.cypher("CALL show_attached_databases() RETURN name AS name")) == [("one",)]
    other.cypher("USE one")
    assert rows(other.cypher("MATCH (a:N) RETURN a.name AS name")) == [("x",)]
    other.cypher("DETACH one")


def test_sources_that_need_packages_say_so(spark):
    for name in databases.CONNECTORS:
        with pytest.raises(databases.SourceError):
            databases.connector_scan(spark, name, "/nowhere")
    with pytest.raises(files.LoadError):
        spark.createDataFrame([(1,)], "a long").write.mode("overwrite").parquet(path := files_path(spark))
        files.read(spark, path, {"format": "parquet"}, spark.createDataFrame([], "b long").schema)


def files_path(spark):
    from meshwork.plans.lineage import scratch

    return scratch(spark, "plain")
