"""A whole catalog as a folder: Parquet by table and a manifest, written and read through Spark's file systems."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from meshwork.operators.tables import Catalog, NodeTable, RelTable


def export_catalog(catalog: Catalog, path: str, schema_only: bool = False) -> None:
    tables: list[dict[str, Any]] = []
    for t in [*catalog.nodes.values(), *catalog.rels.values()]:
        kind = {"kind": "node", "key": t.key, "serial": t.serial} if isinstance(t, NodeTable) else {"kind": "rel", "from": t.source, "to": t.target}
        tables.append({"name": t.name, "schema": json.loads(t.df.schema.json()), **kind})
        if not schema_only:
            t.df.write.mode("overwrite").parquet(f"{path}/{t.name}")
    rest = {"indexes": catalog.indexes, "sequences": {k: vars(s) for k, s in catalog.sequences.items()}, "comments": catalog.comments, "graphs": catalog.graphs, "schema_only": schema_only}
    catalog.spark.createDataFrame([(json.dumps({"tables": tables, **rest}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_manifest")


def import_catalog(catalog: Catalog, spark: SparkSession, path: str) -> None:
    from meshwork.operators.tables import Sequence

    m = json.loads(spark.read.text(f"{path}/_manifest").first()["value"])
    for t in m["tables"]:
        schema = T.StructType.fromJson(t["schema"])
        df = spark.createDataFrame([], schema) if m["schema_only"] else spark.read.schema(schema).parquet(f"{path}/{t['name']}")
        catalog.put(NodeTable(t["name"], t["key"], df, t.get("serial")) if t["kind"] == "node" else RelTable(t["name"], t["from"], t["to"], df))
    catalog.indexes.update(m["indexes"])
    catalog.sequences.update({k: Sequence(**v) for k, v in m["sequences"].items()})
    catalog.comments.update(m["comments"])
    catalog.graphs.update(m["graphs"])
