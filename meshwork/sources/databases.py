"""Tables of other systems. What needs a driver or a jar that isn't there says so."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Spark formats by scan function; each needs its package on the class path.
CONNECTORS = {"delta_scan": "delta", "iceberg_scan": "iceberg", "azure_scan": "parquet", "uc_scan": "unity", "http_scan": "parquet", "https_scan": "parquet"}


class SourceError(ValueError):
    """A source that can't be read here."""


def connector_scan(spark: SparkSession, name: str, path: str) -> DataFrame:
    try:
        return spark.read.format(CONNECTORS[name]).load(path)
    except Exception as e:
        raise SourceError(f"{name} can't read {path}: {str(e).splitlines()[0][:200]}") from e


def iceberg_metadata(spark: SparkSession, table: str, kind: str = "snapshots") -> DataFrame:
    return spark.read.format("iceberg").load(f"{table}.{kind}")


def jdbc_query(spark: SparkSession, url: str, query: str, **options: Any) -> DataFrame:
    """A query pushed to a database; partitionColumn, lowerBound, upperBound and numPartitions split the read."""
    if options.get("partitionColumn"):
        return spark.read.format("jdbc").options(url=url, dbtable=f"({query}) q", **options).load()
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def arrow_rows(spark: SparkSession, batches: Iterator[Any]) -> DataFrame:
    import pyarrow as pa

    return spark.createDataFrame(pa.Table.from_batches(list(batches)))


def duckdb_query(spark: SparkSession, path: str, sql: str) -> DataFrame:
    """Result of a query on a DuckDB file, through Arrow. The file is local to the driver, as is the result."""
    import duckdb

    with duckdb.connect(path, read_only=path != ":memory:") as c:
        return spark.createDataFrame(c.sql(sql).to_arrow_table())


def sqlite_query(spark: SparkSession, path: str, sql: str) -> DataFrame:
    """Result of a query on an SQLite file that the driver can open."""
    import sqlite3

    import pandas as pd

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        return spark.createDataFrame(pd.read_sql_query(sql, c))


_NODE = re.compile(r"CREATE\s*\((?:(\w+))?\s*:\s*`?(\w+)`?\s*(\{.*\})?\s*\)\s*;?\s*$", re.IGNORECASE)
_EDGE = re.compile(r"\((\w+)\s*\)\s*-\s*\[\s*:\s*`?(\w+)`?\s*(\{.*\})?\s*\]\s*->\s*\((\w+)\s*\)", re.IGNORECASE)
_MATCHED = re.compile(r"\((\w+)\s*:\s*`?(\w+)`?\s*(\{[^}]*\})\s*\)", re.IGNORECASE)


def read_dump(text: str) -> tuple[dict[str, list[dict]], dict[str, list[tuple[str, dict, str, dict, dict]]]]:
    """Nodes by label and edges by type of a dump of CREATE statements, one a line. Edges give their end nodes' labels
    and properties: `MATCH (a:L {..}), (b:M {..}) CREATE (a)-[:T {..}]->(b)`, or variables of earlier lines."""
    from meshwork.plans import nodes as n
    from meshwork.plans.parser import Parser

    def props(x: str | None) -> dict:
        if not x:
            return {}
        return {k: v.value if isinstance(v, n.Lit) else None for k, v in Parser(x).properties()}

    found: dict[str, list[dict]] = {}
    edges: dict[str, list] = {}
    known: dict[str, tuple[str, dict]] = {}
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("//") or line.startswith(":"):
            continue
        if m := _EDGE.search(line):
            local = {v: (label, props(p)) for v, label, p in _MATCHED.findall(line)}
            a, b = local.get(m[1]) or known.get(m[1]), local.get(m[4]) or known.get(m[4])
            if a is None or b is None:
                raise SourceError(f"edge between unknown nodes: {line[:80]}")
            edges.setdefault(m[2], []).append((*a, *b, props(m[3])))
        elif m := _NODE.match(line):
            found.setdefault(m[2], []).append(props(m[3]))
            if m[1]:
                known[m[1]] = (m[2], found[m[2]][-1])
    return found, edges
