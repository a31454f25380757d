"""The engine: a catalog of node and edge tables, and queries over them."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshwork import __version__
from meshwork.functions import AGGREGATES, SCALARS
from meshwork.functions.scalars import spark_type
from meshwork.operators import algorithms, search
from meshwork.operators.tables import Catalog, CatalogError, NodeTable, RelTable, Sequence
from meshwork.plans import nodes as n
from meshwork.plans.lineage import partition_places, partition_starts, scratch, settled, written
from meshwork.plans.lower import Lowering
from meshwork.plans.parser import parse
from meshwork.sources import catalogs, databases, files


@dataclass(frozen=True)
class Prepared:
    """A parsed statement that runs with different parameters."""

    engine: Engine
    statement: Any

    def execute(self, params: dict[str, Any] | None = None) -> DataFrame:
        return self.engine.run(self.statement, params)


class Engine:
    """Queries are lazy DataFrames; statements that change something run at once and return a message row."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.catalog = Catalog(spark)
        self.functions: dict[str, Callable[..., Column]] = {}
        self.table_functions: dict[str, Callable[..., DataFrame]] = {}
        self.seed: int | None = None
        self.changed = 0
        self._saved: Catalog | None = None
        self._fts: dict[str, tuple[DataFrame, tuple[DataFrame, DataFrame, DataFrame]]] = {}

    # -- queries

    def cypher(self, text: str, params: dict[str, Any] | None = None) -> DataFrame:
        return self.run(parse(text), params)

    def prepare(self, text: str) -> Prepared:
        return Prepared(self, parse(text))

    def run(self, statement: Any, params: dict[str, Any] | None = None) -> DataFrame:
        self.changed = 0
        if isinstance(statement, n.Statement):
            return self.statement(statement, params)
        return Lowering(self, params).query(statement)

    def message(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(text,)], "message string")

    # -- registering

    def node_table(self, name: str, key: str, df: DataFrame | Callable[[], DataFrame]) -> None:
        """A table, or what opens it when a query first uses it."""
        self.catalog.add_node(name, key, df)

    def rel_table(self, name: str, source: str, target: str, df: DataFrame | Callable[[], DataFrame]) -> None:
        self.catalog.add_rel(name, source, target, df)

    def register_function(self, name: str, build: Callable[..., Column]) -> None:
        """A scalar function: a builder of columns, or a udf or pandas_udf."""
        self.functions[name.lower()] = build

    def register_table_function(self, name: str, f: Callable[..., DataFrame]) -> None:
        """A function for CALL: it gets the engine and the arguments."""
        self.table_functions[name.lower()] = f

    def numbered(self, df: DataFrame, column: str, start: int) -> DataFrame:
        """df with consecutive numbers, from partition sizes rather than one sorted task."""
        placed = settled(df.select("*", *partition_places()))
        out = placed.join(F.broadcast(partition_starts(placed)), "_part").withColumn(column, F.col("_start") + F.col("_place") + start)
        return out.select(*(F.col(f"`{c}`") for c in df.columns), column)

    def scratch(self, name: str) -> str:
        return scratch(self.spark, name)

    def next(self, name: str) -> int:
        return self._sequence(name).next()

    def current(self, name: str) -> int:
        return self._sequence(name).current()

    def _sequence(self, name: str) -> Sequence:
        if name not in self.catalog.sequences:
            raise CatalogError(f"no sequence {name}")
        return self.catalog.sequences[name]

    # -- statements

    def statement(self, s: n.Statement, params: dict[str, Any] | None = None) -> DataFrame:
        done = getattr(self, f"do_{s.kind}", None)
        if done is None:
            raise CatalogError(f"no statement {s.kind}")
        out = done(params=params, **s.args) if s.kind in ("explain", "copy_to") else done(**s.args)
        return out if isinstance(out, DataFrame) else self.message(out or "ok")

    def new_name(self, name: str, exists: bool = False) -> bool:
        if name in self.catalog.nodes or name in self.catalog.rels:
            if exists:
                return False
            raise CatalogError(f"{name} exists already")
        return True

    def empty(self, columns: list[tuple[str, str]]) -> DataFrame:
        schema = ", ".join(f"`{c}` {spark_type(self.catalog.types.get(t, t))}" for c, t in columns)
        return self.spark.createDataFrame([], schema)

    def do_create_node(self, name: str, columns: list, key: str, if_not_exists: bool = False) -> str:
        if not self.new_name(name, if_not_exists):
            return f"{name} exists already"
        if key not in [c for c, _ in columns]:
            raise CatalogError(f"{name} has no column {key}")
        serial = next((c for c, t in columns if t == "SERIAL"), None)
        self.catalog.put(NodeTable(name, key, self.empty(columns), serial))
        return f"node table {name} created"

    def do_create_rel(self, name: str, columns: list, if_not_exists: bool = False, **ends: str) -> str:
        if not self.new_name(name, if_not_exists):
            return f"{name} exists already"
        a, b = ends["from"], ends["to"]
        for label in (a, b):
            if label not in self.catalog.nodes:
                raise CatalogError(f"no node table {label}")
        kind = {x: t.df.schema[t.key].dataType.simpleString() for x, t in ((x, self.catalog.nodes[x]) for x in (a, b))}
        props = self.empty(columns).schema.fields if columns else []
        schema = T.StructType([T.StructField("_src", T._parse_datatype_string(kind[a])), T.StructField("_dst", T._parse_datatype_string(kind[b])), *props])
        self.catalog.put(RelTable(name, a, b, self.spark.createDataFrame([], schema)))
        return f"rel table {name} created"

    def do_drop_table(self, name: str, if_exists: bool = False) -> str:
        c = self.catalog
        if name not in c.nodes and name not in c.rels:
            if if_exists:
                return f"no table {name}"
            raise CatalogError(f"no table {name}")
        used = [r.name for r in c.rels.values() if name in (r.source, r.target)]
        if name in c.nodes and used:
            raise CatalogError(f"{name} is an end of {used[0]}")
        c.nodes.pop(name, None)
        c.rels.pop(name, None)
        c.version += 1
        return f"{name} dropped"

    def do_alter(self, name: str, action: str, column: str = "", type: str = "", to: str = "") -> str:  # noqa: A002
        t = self.catalog.table(name)
        key = t.key if isinstance(t, NodeTable) else None
        if action == "rename_table":
            self.new_name(to)
            del (self.catalog.nodes if isinstance(t, NodeTable) else self.catalog.rels)[name]
            self.catalog.put(NodeTable(to, t.key, t.df, t.serial) if isinstance(t, NodeTable) else RelTable(to, t.source, t.target, t.df))
            for r in list(self.catalog.rels.values()):
                if name in (r.source, r.target):
                    self.catalog.put(RelTable(r.name, to if r.source == name else r.source, to if r.target == name else r.target, r.df))
            return f"{name} is now {to}"
        if action == "add":
            if column in t.columns:
                raise CatalogError(f"{name} has a column {column} already")
            df = t.df.withColumn(column, F.lit(None).cast(spark_type(type)))
        else:
            if column not in t.columns:
                raise CatalogError(f"{name} has no column {column}")
            if action == "drop" and column == key:
                raise CatalogError(f"{column} is the key of {name}")
            df = t.df.drop(column) if action == "drop" else t.df.withColumnRenamed(column, to)
            key = to if action == "rename" and column == key else key
        self.catalog.put(NodeTable(name, key, df, t.serial) if isinstance(t, NodeTable) else RelTable(name, t.source, t.target, df))
        return f"{name} altered"

    def do_create_index(self, kind: str, name: str, table: str, column: str, options: dict | None = None, if_not_exists: bool = False) -> str:
        t = self.catalog.table(table)
        if column not in t.columns:
            raise CatalogError(f"{table} has no column {column}")
        if name in self.catalog.indexes:
            if if_not_exists:
                return f"index {name} exists already"
            raise CatalogError(f"index {name} exists already")
        options = options or {}
        if kind == "VECTOR":
            if options.get("metric", "cosine") not in search.METRICS:
                raise CatalogError(f"no metric {options['metric']}")
            dims = options.get("dims")
            if dims is not None and not t.df.filter(F.size(column) != dims).isEmpty():
                raise CatalogError(f"{table}.{column} has vectors of other than {dims} dimensions")
        self.catalog.indexes[name] = {"kind": kind, "table": table, "column": column, "options": options}
        return f"index {name} created"

    def do_drop_index(self, name: str, table: str) -> str:
        if self.catalog.indexes.get(name, {}).get("table") != table:
            raise CatalogError(f"no index {name} on {table}")
        del self.catalog.indexes[name]
        return f"index {name} dropped"

    def do_create_sequence(self, name: str, or_replace: bool = False, if_not_exists: bool = False, start: int | None = None, increment: int = 1, min: int | None = None, max: int | None = None, cycle: bool = False) -> str:  # noqa: A002
        if name in self.catalog.sequences and not or_replace:
            if if_not_exists:
                return f"sequence {name} exists already"
            raise CatalogError(f"sequence {name} exists already")
        if not increment:
            raise CatalogError("a sequence needs an increment")
        low = min if min is not None else 1 if increment > 0 else -(2**63)
        high = max if max is not None else 2**63 - 1 if increment > 0 else -1
        self.catalog.sequences[name] = Sequence(start if start is not None else low if increment > 0 else high, increment, low, high, cycle)
        return f"sequence {name} created"

    def do_drop_sequence(self, name: str, if_exists: bool = False) -> str:
        if self.catalog.sequences.pop(name, None) is None and not if_exists:
            raise CatalogError(f"no sequence {name}")
        return f"sequence {name} dropped"

    def do_create_macro(self, name: str, params: list, body: n.Expr) -> str:
        if name.lower() in self.catalog.macros:
            raise CatalogError(f"macro {name} exists already")
        self.catalog.macros[name.lower()] = (params, body)
        return f"macro {name} created"

    def do_create_type(self, name: str, type: str) -> str:  # noqa: A002
        spark_type(type)
        self.catalog.types[name.upper()] = type
        return f"type {name} created"

    def do_comment(self, name: str, text: str) -> str:
        self.catalog.table(name)
        self.catalog.comments[name] = text
        return f"{name} commented"

    def do_copy_from(self, table: str, path: str, options: dict) -> str:
        """Appends a file's rows. Edge files begin with the two end nodes' keys; unknown ends raise."""
        from meshwork.plans.updates import append, insert_nodes

        t = self.catalog.table(table)
        low = Lowering(self)
        if isinstance(t, NodeTable):
            columns = T.StructType([f for f in t.df.schema if f.name != t.serial])
            insert_nodes(low, table, files.read(self.spark, path, options, columns))
        else:
            df = settled(files.read(self.spark, path, options, t.df.schema))
            for end, label in (("_src", t.source), ("_dst", t.target)):
                k = self.catalog.nodes[label]
                if not df.join(k.df.select(k.key), F.col(end) == F.col(k.key), "left_anti").isEmpty():
                    raise files.LoadError(f"{path} names {label} nodes that don't exist")
            append(low, t, df)
        return f"{self.changed} rows copied to {table}"

    def do_copy_to(self, query: Any, path: str, options: dict, params: dict | None = None) -> str:
        files.write(Lowering(self, params).query(query), path, options)
        return f"written to {path}"

    def do_export(self, path: str, options: dict) -> str:
        catalogs.export_catalog(self.catalog, path, bool(options.get("schema_only", False)))
        return f"exported to {path}"

    def do_import(self, path: str, options: dict) -> str:
        catalogs.import_catalog(self.catalog, self.spark, path)
        return f"imported from {path}"

    def do_analyze(self, table: str | None) -> DataFrame:
        return self.stats([table] if table else None)

    def stats(self, names: list[str] | None = None) -> DataFrame:
        rows = [(x, self.catalog.table(x).df.count(), len(self.catalog.table(x).columns)) for x in (names or [*self.catalog.nodes, *self.catalog.rels])]
        return self.spark.createDataFrame(rows, "table string, rows long, columns int")

    def do_begin(self) -> str:
        if self._saved is not None:
            raise CatalogError("a transaction is open already")
        self._saved = self.catalog.copy()
        return "transaction begun"

    def do_commit(self) -> str:
        if self._saved is None:
            raise CatalogError("no transaction is open")
        self._saved = None
        return "committed"

    def do_rollback(self) -> str:
        if self._saved is None:
            raise CatalogError("no transaction is open")
        self.catalog, self._saved = self._saved, None
        return "rolled back"

    def do_checkpoint(self) -> str:
        for t in [*self.catalog.nodes.values(), *self.catalog.rels.values()]:
            df = settled(t.df)
            self.catalog.put(NodeTable(t.name, t.key, df, t.serial) if isinstance(t, NodeTable) else RelTable(t.name, t.source, t.target, df))
        return "checkpointed"

    def do_create_graph(self, name: str) -> str:
        if name in self.catalog.graphs:
            raise CatalogError(f"graph {name} exists already")
        self.catalog.graphs[name] = {"nodes": sorted(self.catalog.nodes), "rels": sorted(self.catalog.rels)}
        return f"graph {name} created"

    def do_use_graph(self, name: str) -> str:
        if name not in self.catalog.graphs:
            raise CatalogError(f"no graph {name}")
        self.catalog.active_graph = name
        return f"using {name}"

    def do_drop_graph(self, name: str) -> str:
        if self.catalog.graphs.pop(name, None) is None:
            raise CatalogError(f"no graph {name}")
        if self.catalog.active_graph == name:
            self.catalog.active_graph = None
        return f"graph {name} dropped"

    def do_attach(self, path: str, name: str, options: dict) -> str:
        self.catalog.attached[name] = path
        return f"{path} attached as {name}"

    def do_detach(self, name: str) -> str:
        if self.catalog.attached.pop(name, None) is None:
            raise CatalogError(f"no database {name}")
        return f"{name} detached"

    def do_use(self, name: str) -> str:
        """Reads an attached export into this catalog."""
        if name not in self.catalog.attached:
            raise CatalogError(f"no database {name}")
        catalogs.import_catalog(self.catalog, self.spark, self.catalog.attached[name])
        return f"using {name}"

    def do_load_extension(self, name: str) -> str:
        self.catalog.extensions.add(name.lower())
        return f"{name} loaded"

    do_install_extension = do_load_extension

    def do_uninstall_extension(self, name: str) -> str:
        self.catalog.extensions.discard(name.lower())
        return f"{name} removed"

    def do_setting(self, key: str, value: Any) -> str:
        self.catalog.settings[key] = value
        if key.startswith("spark."):
            self.spark.conf.set(key, value)
        return f"{key} = {value}"

    def do_explain(self, mode: str, inner: Any, params: dict | None = None) -> DataFrame:
        begun = time.perf_counter()
        df = self.run(inner, params)
        qe = df._jdf.queryExecution()
        if mode == "PROFILE":
            rows = df.count()
            text = f"rows {rows}, seconds {time.perf_counter() - begun:.3f}\n{qe.executedPlan().toString()}"
        else:
            text = qe.optimizedPlan().toString() if mode == "LOGICAL" else qe.executedPlan().toString()
        return self.spark.createDataFrame([(text,)], "plan string")

    # -- CALL and LOAD FROM

    def load(self, path: str, options: dict) -> DataFrame:
        return files.read(self.spark, path, options)

    def graph(self, directed: bool = False) -> tuple[DataFrame, DataFrame]:
        names = self.catalog.graphs[self.catalog.active_graph]["rels"] if self.catalog.active_graph else None
        return self.catalog.edges(names), self.catalog.vertices(names)

    def fts_index(self, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The index's tables, rebuilt when its table has changed."""
        ix = self.catalog.indexes.get(name)
        if ix is None or ix["kind"] != "FTS":
            raise CatalogError(f"no full-text index {name}")
        t = self.catalog.nodes[ix["table"]]
        held = self._fts.get(name)
        if held is None or held[0] is not t.df:  # tables don't change; a new version is another object
            held = (t.df, tuple(map(written, search.postings(t.df, t.key, ix["column"]))))
            self._fts[name] = held
        return held[1]

    def fts_search(self, name: str, query: str) -> DataFrame:
        return search.bm25(self.fts_index(name), query)

    def call(self, name: str, args: list[Any]) -> DataFrame:
        name = name.lower()
        if name in self.table_functions:
            return self.table_functions[name](self, *args)
        if name in ALGORITHMS:
            f, least = ALGORITHMS[name]
            if len(args) < least:
                raise CatalogError(f"{name} needs {least} arguments")
            edges, vertices = self.graph()
            return f(edges, vertices, *args)
        found = getattr(self, f"call_{name}", None)
        if found is None:
            raise CatalogError(f"no function {name} to call")
        return found(*args)

    def rows(self, schema: str, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def call_show_tables(self) -> DataFrame:
        return self.rows("name string, kind string", [(x, "NODE") for x in self.catalog.nodes] + [(x, "REL") for x in self.catalog.rels])

    call_list_tables = call_tables = call_show_tables

    def call_table_info(self, name: str) -> DataFrame:
        t = self.catalog.table(name)
        key = t.key if isinstance(t, NodeTable) else None
        return self.rows("`table` string, `column` string, type string, nullable string", [(name, f.name, f.dataType.simpleString(), "NO" if f.name == key else "YES") for f in t.df.schema if f.name in t.columns])

    def call_show_functions(self) -> DataFrame:
        every = [(x, "SCALAR") for x in [*SCALARS, *self.functions, "list_transform", "list_filter", "list_reduce"]] + [(x, "AGGREGATE") for x in AGGREGATES] + [(x, "TABLE") for x in [*ALGORITHMS, *self.table_functions, *(k[5:] for k in dir(self) if k.startswith("call_"))]]
        return self.rows("name string, kind string", every)

    def call_show_indexes(self) -> DataFrame:
        return self.rows("name string, kind string, `table` string, `column` string", [(k, v["kind"], v["table"], v["column"]) for k, v in self.catalog.indexes.items()])

    def call_show_sequences(self) -> DataFrame:
        return self.rows("name string, start long, increment long, value long", [(k, s.start, s.increment, s.value) for k, s in self.catalog.sequences.items()])

    def call_show_macros(self) -> DataFrame:
        return self.rows("name string, parameters string", [(k, ", ".join(p for p, _ in v[0])) for k, v in self.catalog.macros.items()])

    def call_show_connection(self, rel: str) -> DataFrame:
        r = self.catalog.rels.get(rel)
        if r is None:
            raise CatalogError(f"no rel table {rel}")
        return self.rows("source string, target string", [(r.source, r.target)])

    def call_db_version(self) -> DataFrame:
        return self.rows("version string", [(__version__,)])

    def call_catalog_version(self) -> DataFrame:
        return self.rows("version long", [(self.catalog.version,)])

    def call_storage_version(self) -> DataFrame:
        return self.rows("version string", [(self.spark.version,)])

    def call_current_setting(self, key: str) -> DataFrame:
        v = self.catalog.settings.get(key)
        return self.rows("value string", [(str(v) if v is not None else self.spark.conf.get(key, None),)])

    def call_stats_info(self) -> DataFrame:
        return self.stats()

    def call_storage_info(self, name: str | None = None) -> DataFrame:
        names = [name] if name else [*self.catalog.nodes, *self.catalog.rels]
        return self.rows("`table` string, file string", [(x, f) for x in names for f in self.catalog.table(x).df.inputFiles()])

    call_file_info = call_storage_info

    def call_show_attached_databases(self) -> DataFrame:
        return self.rows("name string, path string", list(self.catalog.attached.items()))

    def call_bm_info(self) -> DataFrame:
        status = self.spark.sparkContext._jsc.sc().getExecutorMemoryStatus().toString()
        return self.rows("name string, value string", [("executor_memory", status)])

    def call_free_space_info(self) -> DataFrame:
        return self.rows("name string, value long", [])

    def call_disk_size_info(self) -> DataFrame:
        return self.rows("`table` string, files long", [(x, len(self.catalog.table(x).df.inputFiles())) for x in [*self.catalog.nodes, *self.catalog.rels]])

    def call_show_loaded_extensions(self) -> DataFrame:
        return self.rows("name string", [(x,) for x in sorted(self.catalog.extensions)])

    def call_show_official_extensions(self) -> DataFrame:
        return self.rows("name string", [(x,) for x in ("algo", "azure", "delta", "duckdb", "fts", "httpfs", "iceberg", "json", "llm", "neo4j", "postgres", "sqlite", "unity_catalog", "vector")])

    def call_show_warnings(self) -> DataFrame:
        return self.rows("message string", [(x,) for x in self.catalog.warnings])

    def call_clear_warnings(self) -> DataFrame:
        self.catalog.warnings.clear()
        return self.message("ok")

    def call_export_csv(self, path: str, query: str) -> DataFrame:
        files.write(self.cypher(query), path, {"format": "csv"})
        return self.message(f"written to {path}")

    def call_export_parquet(self, path: str, query: str) -> DataFrame:
        files.write(self.cypher(query), path, {"format": "parquet"})
        return self.message(f"written to {path}")

    def call_show_projected_graphs(self) -> DataFrame:
        return self.rows("name string, nodes string, rels string", [(k, ",".join(v["nodes"]), ",".join(v["rels"])) for k, v in self.catalog.graphs.items()])

    def call_projected_graph_info(self, name: str) -> DataFrame:
        g = self.catalog.graphs.get(name)
        if g is None:
            raise CatalogError(f"no graph {name}")
        return self.rows("kind string, `table` string", [("NODE", x) for x in g["nodes"]] + [("REL", x) for x in g["rels"]])

    def call_project_graph(self, name: str, nodes: list[str], rels: list[str]) -> DataFrame:
        for x in [*nodes, *rels]:
            self.catalog.table(x)
        self.catalog.graphs[name] = {"nodes": list(nodes), "rels": list(rels)}
        return self.message(f"graph {name} created")

    def call_drop_projected_graph(self, name: str) -> DataFrame:
        return self.message(self.do_drop_graph(name))

    def call_vector_similarity_scan(self, table: str, column: str, vector: list[float], k: int) -> DataFrame:
        t = self.catalog.nodes.get(table)
        if t is None:
            raise CatalogError(f"no node table {table}")
        metric = next((ix["options"].get("metric", "cosine") for ix in self.catalog.indexes.values() if ix["kind"] == "VECTOR" and (ix["table"], ix["column"]) == (table, column)), "cosine")
        return search.vector_top(t.df, t.key, column, vector, k, metric)

    def call_query_vector_index(self, index: str, vector: list[float], k: int) -> DataFrame:
        ix = self.catalog.indexes.get(index)
        if ix is None or ix["kind"] != "VECTOR":
            raise CatalogError(f"no vector index {index}")
        return self.call_vector_similarity_scan(ix["table"], ix["column"], vector, k)

    def call_query_fts_index(self, index: str, query: str, k: int | None = None) -> DataFrame:
        out = self.fts_search(index, query).orderBy(F.desc("score"), "doc_id")
        return out if k is None else out.limit(k)

    def call_hybrid_search(self, fts: str, query: str, vector_index: str, vector: list[float], k: int = 10) -> DataFrame:
        text = self.fts_search(fts, query).select(F.col("doc_id").alias("id"), "score")
        return search.hybrid(self.call_query_vector_index(vector_index, vector, 10 * k), text.orderBy(F.desc("score"), "id").limit(10 * k), limit=k)

    def call_duckdb_query(self, sql: str, path: str = ":memory:") -> DataFrame:
        return databases.duckdb_query(self.spark, path, sql)

    def call_duckdb_scan(self, table: str, path: str = ":memory:") -> DataFrame:
        return databases.duckdb_query(self.spark, path, f'SELECT * FROM "{table}"')

    def call_sqlite_query(self, sql: str, path: str) -> DataFrame:
        return databases.sqlite_query(self.spark, path, sql)

    def call_sqlite_scan(self, table: str, path: str) -> DataFrame:
        return databases.sqlite_query(self.spark, path, f'SELECT * FROM "{table}"')

    def call_sql_query(self, sql: str, url: str) -> DataFrame:
        return databases.jdbc_query(self.spark, url, sql)

    def call_neo4j_migrate(self, path: str, key: str = "id") -> DataFrame:
        """Node and rel tables from a dump of CREATE statements."""
        text = "\n".join(r["value"] for r in self.spark.read.text(path).collect())
        found, edges = databases.read_dump(text)
        for label, rows in found.items():
            names = list(dict.fromkeys(k for r in rows for k in r))
            k = key if key in names else names[0]
            self.node_table(label, k, self.spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], names))
        for name, rows in edges.items():
            a, b = rows[0][0], rows[0][2]
            ka, kb = self.catalog.nodes[a].key, self.catalog.nodes[b].key
            names = list(dict.fromkeys(k for r in rows for k in r[4]))
            self.rel_table(name, a, b, self.spark.createDataFrame([(r[1][ka], r[3][kb], *(r[4].get(c) for c in names)) for r in rows], ["_src", "_dst", *names]))
        return self.message(f"{sum(map(len, found.values()))} nodes, {sum(map(len, edges.values()))} edges")


for _name in databases.CONNECTORS:
    setattr(Engine, f"call_{_name}", lambda self, path, _name=_name: databases.connector_scan(self.spark, _name, path))
Engine.call_iceberg_metadata = lambda self, table: databases.iceberg_metadata(self.spark, table, "files")
Engine.call_iceberg_snapshots = lambda self, table: databases.iceberg_metadata(self.spark, table)


def _ids(text: str, edges: DataFrame) -> list:
    whole = isinstance(edges.schema["src"].dataType, T.IntegralType)
    return [int(x) if whole else x.strip() for x in str(text).split(",")]


_a = algorithms
#: Callable algorithms: function of (edges, vertices, *arguments) and the number of arguments that it needs.
ALGORITHMS: dict[str, tuple[Callable[..., DataFrame], int]] = {}
for _names, _f, _n in (
    ("page_rank pr", lambda e, v: _a.page_rank(e, v), 0),
    ("weakly_connected_components wcc", lambda e, v: _a.connected_components(e, v), 0),
    ("strongly_connected_components scc strongly_connected_components_kosaraju scc_ko", lambda e, v: _a.strong_components(e, v), 0),
    ("k_core_decomposition kcore", lambda e, v: _a.k_core(e, v), 0),
    ("louvain", lambda e, v, seed=None, gain=0.001, rounds=20: _a.louvain(e, v, gain, rounds), 0),
    ("spread_activation", lambda e, v, ids, decay=0.5, threshold=0.01, hops=3: _a.spread_activation(e, _ids(ids, e), decay, threshold, hops), 1),
    ("spanning_forest sf", lambda e, v: _a.spanning_forest(e, v), 0),
    ("label_propagation lpa", lambda e, v, rounds=10: _a.label_propagation(e, v, rounds), 0),
    ("betweenness_centrality bc", lambda e, v: _a.betweenness(e, v), 0),
    ("closeness_centrality cc", lambda e, v: _a.closeness(e, v), 0),
    ("degree_centrality", lambda e, v: _a.degrees(e, v), 0),
    ("triangle_count tc", lambda e, v: _a.triangles(e, v), 0),
    ("all_sp_destinations", lambda e, v: _a.reachable_counts(e, v), 0),
    ("shortest_path sp", lambda e, v, source: _a.shortest_path(e, source), 1),
    ("weighted_shortest_path", lambda e, v, source: _a.weighted_shortest_path(e, source), 1),
    ("random_walk rw", lambda e, v, steps=5, walks=2: _a.random_walk(e, v, steps, walks), 0),
    ("node2vec n2v", lambda e, v, p=1.0, q=1.0, dims=4, walks=3, window=5: _a.node2vec(e, v, float(p), float(q), dims, walks, window), 0),
):
    for _x in _names.split():
        ALGORITHMS[_x] = (_f, _n)
