"""Node and edge tables: DataFrames with a schema, and the catalog that holds them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CatalogError(ValueError):
    """A name that is unknown or taken, or a change that the schema forbids."""


def opened(held: DataFrame | Callable[[], DataFrame]) -> DataFrame:
    return held() if callable(held) else held


@dataclass(frozen=True)
class NodeTable:
    """Rows of one label, told apart by the column `key`."""

    name: str
    key: str
    held: DataFrame | Callable[[], DataFrame]
    serial: str | None = None

    @cached_property
    def df(self) -> DataFrame:
        return opened(self.held)

    @property
    def columns(self) -> list[str]:
        return self.df.columns


@dataclass(frozen=True)
class RelTable:
    """Edges from `source` to `target` nodes: _src and _dst hold their keys, further columns are properties."""

    name: str
    source: str
    target: str
    held: DataFrame | Callable[[], DataFrame]

    @cached_property
    def df(self) -> DataFrame:
        return opened(self.held)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("_src", "_dst")]


@dataclass
class Sequence:
    start: int = 1
    increment: int = 1
    low: int = 1
    high: int = 2**63 - 1
    cycle: bool = False
    value: int | None = None

    def next(self) -> int:
        v = self.start if self.value is None else self.value + self.increment
        if not self.low <= v <= self.high:
            if not self.cycle:
                raise CatalogError("the sequence is exhausted")
            v = self.low if self.increment > 0 else self.high
        self.value = v
        return v

    def current(self) -> int:
        if self.value is None:
            raise CatalogError("nextval has to come first")
        return self.value


@dataclass
class Catalog:
    spark: SparkSession
    nodes: dict[str, NodeTable] = field(default_factory=dict)
    rels: dict[str, RelTable] = field(default_factory=dict)
    indexes: dict[str, dict[str, Any]] = field(default_factory=dict)
    sequences: dict[str, Sequence] = field(default_factory=dict)
    macros: dict[str, tuple[list, Any]] = field(default_factory=dict)
    graphs: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    comments: dict[str, str] = field(default_factory=dict)
    attached: dict[str, str] = field(default_factory=dict)
    extensions: set[str] = field(default_factory=lambda: {"json", "fts", "vector", "httpfs", "duckdb", "algo"})
    settings: dict[str, Any] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    active_graph: str | None = None
    version: int = 0

    def copy(self) -> Catalog:
        """A snapshot: tables are immutable, so the dictionaries are all there is to copy."""
        return replace(self, nodes=dict(self.nodes), rels=dict(self.rels), indexes=dict(self.indexes), sequences={k: replace(v) for k, v in self.sequences.items()}, macros=dict(self.macros), graphs=dict(self.graphs), comments=dict(self.comments))

    def table(self, name: str) -> NodeTable | RelTable:
        found = self.nodes.get(name) or self.rels.get(name)
        if found is None:
            raise CatalogError(f"no table {name}")
        return found

    def put(self, table: NodeTable | RelTable) -> None:
        (self.nodes if isinstance(table, NodeTable) else self.rels)[table.name] = table
        self.version += 1

    def add_node(self, name: str, key: str, df: DataFrame | Callable[[], DataFrame]) -> None:
        if not callable(df) and key not in df.columns:
            raise CatalogError(f"{name} has no column {key}")
        self.put(NodeTable(name, key, df))

    def add_rel(self, name: str, source: str, target: str, df: DataFrame | Callable[[], DataFrame]) -> None:
        for label in (source, target):
            if label not in self.nodes:
                raise CatalogError(f"no node table {label}")
        if not callable(df) and not {"_src", "_dst"} <= set(df.columns):
            raise CatalogError(f"{name} needs _src and _dst")
        self.put(RelTable(name, source, target, df))

    def edges(self, names: list[str] | None = None) -> DataFrame:
        """(src, dst) over the given rel tables; keys carry their label where several labels take part."""
        rels = [self.rels[x] for x in (names or sorted(self.rels))]
        if not rels:
            raise CatalogError("no rel tables")
        labels = {x for r in rels for x in (r.source, r.target)}
        mark = (lambda label, c: F.col(c)) if len(labels) == 1 else (lambda label, c: F.concat(F.lit(label + ":"), F.col(c).cast("string")))
        out = None
        for r in rels:
            e = r.df.select(mark(r.source, "_src").alias("src"), mark(r.target, "_dst").alias("dst"), *([F.col("weight").cast("double")] if "weight" in r.columns else [F.lit(1.0).alias("weight")]))
            out = e if out is None else out.unionByName(e)
        return out

    def vertices(self, names: list[str] | None = None) -> DataFrame:
        rels = [self.rels[x] for x in (names or sorted(self.rels))]
        labels = sorted({x for r in rels for x in (r.source, r.target)})
        out = None
        for label in labels:
            t = self.nodes[label]
            k = F.col(t.key) if len(labels) == 1 else F.concat(F.lit(label + ":"), F.col(t.key).cast("string"))
            v = t.df.select(k.alias("id"))
            out = v if out is None else out.unionByName(v)
        return out
