"""Syntax tree of queries."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class Expr:
    """Any expression."""


@dataclass(frozen=True)
class Lit(Expr):
    value: Any


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class Var(Expr):
    name: str


@dataclass(frozen=True)
class Prop(Expr):
    of: Expr
    name: str


@dataclass(frozen=True)
class Item(Expr):
    of: Expr
    index: Expr


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...] = ()
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Op(Expr):
    """An operator with its operands: or, and, xor, not, =, <>, +, in, like, between, is null, ..."""

    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Case(Expr):
    subject: Expr | None
    branches: tuple[tuple[Expr, Expr], ...]
    default: Expr | None


@dataclass(frozen=True)
class ListOf(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class MapOf(Expr):
    items: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class Quantifier(Expr):
    kind: str
    var: str
    of: Expr
    where: Expr


@dataclass(frozen=True)
class Lambda(Expr):
    var: str
    body: Expr


@dataclass(frozen=True)
class Exists(Expr):
    query: Query


@dataclass(frozen=True)
class NodePattern:
    var: str | None
    label: str | None
    props: tuple[tuple[str, Expr], ...] = ()


@dataclass(frozen=True)
class EdgePattern:
    var: str | None
    label: str | None
    direction: str  # out, in, both
    props: tuple[tuple[str, Expr], ...] = ()
    hops: tuple[int, int | None] | None = None
    mode: str = "reach"  # reach, walk, trail, acyclic


@dataclass(frozen=True)
class Pattern:
    nodes: tuple[NodePattern, ...]
    edges: tuple[EdgePattern, ...] = ()


@dataclass(frozen=True)
class Match:
    patterns: tuple[Pattern, ...]
    where: Expr | None = None
    optional: bool = False
    fts: tuple[str, str] | None = None


@dataclass(frozen=True)
class Unwind:
    expr: Expr
    var: str


@dataclass(frozen=True)
class Projection:
    """RETURN or WITH."""

    items: tuple[tuple[Expr, str | None, str], ...]  # expression, alias, text
    everything: bool = False
    distinct: bool = False
    order: tuple[tuple[Expr, bool], ...] = ()
    limit: Expr | None = None
    skip: Expr | None = None
    where: Expr | None = None
    final: bool = True


@dataclass(frozen=True)
class SetItems:
    items: tuple[tuple[Expr, Expr], ...]


@dataclass(frozen=True)
class Delete:
    exprs: tuple[Expr, ...]
    detach: bool


@dataclass(frozen=True)
class Create:
    patterns: tuple[Pattern, ...]


@dataclass(frozen=True)
class Merge:
    patterns: tuple[Pattern, ...]
    on_create: tuple[tuple[Expr, Expr], ...] = ()
    on_match: tuple[tuple[Expr, Expr], ...] = ()


@dataclass(frozen=True)
class Foreach:
    var: str
    over: Expr
    body: Any


@dataclass(frozen=True)
class CallClause:
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Load:
    path: str
    options: tuple[tuple[str, Any], ...] = ()


@dataclass(frozen=True)
class Query:
    clauses: tuple[Any, ...]


@dataclass(frozen=True)
class Union:
    left: Any
    right: Any
    all: bool


@dataclass(frozen=True)
class Statement:
    """DDL, transaction and utility statements: a kind and what was written with it."""

    kind: str
    args: dict[str, Any] = field(default_factory=dict)
