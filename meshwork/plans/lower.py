"""Lowering of queries to DataFrames: binding, implicit grouping, patterns as joins.

Every pattern variable's properties are flat columns, so filters and column choices reach the scans. Catalyst chooses
join order and strategy; nothing is hinted.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import TYPE_CHECKING, Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshwork.functions import AGGREGATES, SCALARS, Context
from meshwork.operators import traverse
from meshwork.operators.tables import NodeTable, RelTable
from meshwork.plans import nodes as n

if TYPE_CHECKING:
    from meshwork.engine import Engine

_fresh = itertools.count()


class BindError(ValueError):
    """A name that isn't in scope, or that doesn't fit where it stands."""


@dataclass(frozen=True)
class Node:
    label: str | None
    id: str
    props: dict[str, str]
    label_column: str | None = None


@dataclass(frozen=True)
class Rel:
    label: str | None
    src: str
    dst: str
    props: dict[str, str]


@dataclass(frozen=True)
class Value:
    column: str


Binding = Node | Rel | Value


def columns_of(b: Binding) -> list[str]:
    if isinstance(b, Value):
        return [b.column]
    own = [b.id] if isinstance(b, Node) else [b.src, b.dst]
    more = [b.label_column] if isinstance(b, Node) and b.label_column else []
    return list(dict.fromkeys([*own, *more, *b.props.values()]))


@dataclass(frozen=True)
class Scope:
    df: DataFrame | None
    vars: dict[str, Binding] = field(default_factory=dict)

    def with_(self, df: DataFrame, **more: Binding) -> Scope:
        return Scope(df, {**self.vars, **more})


def rebuild(e: Any, f) -> Any:
    """e with f applied to it or, where f gives None, to its parts."""
    got = f(e)
    if got is not None:
        return got
    if isinstance(e, tuple):
        return tuple(rebuild(x, f) for x in e)
    if isinstance(e, (n.Exists, n.Query)):
        return e
    if is_dataclass(e):
        return type(e)(**{k.name: rebuild(getattr(e, k.name), f) for k in fields(e)})
    return e


def parts(e: Any):
    """e and everything below."""
    yield e
    if isinstance(e, tuple):
        for x in e:
            yield from parts(x)
    elif is_dataclass(e) and not isinstance(e, (n.Exists, n.Query)):
        for k in fields(e):
            yield from parts(getattr(e, k.name))


def is_aggregate(e: Any) -> bool:
    return isinstance(e, n.Call) and e.name in AGGREGATES


def has_aggregate(e: Any) -> bool:
    return any(is_aggregate(x) for x in parts(e))


def conjuncts(e: n.Expr | None) -> list[n.Expr]:
    if e is None:
        return []
    if isinstance(e, n.Op) and e.name == "and":
        return [*conjuncts(e.args[0]), *conjuncts(e.args[1])]
    return [e]


class Lowering:
    """Lowers one query against an engine's catalog and parameters."""

    def __init__(self, engine: Engine, params: dict[str, Any] | None = None):
        self.engine, self.params = engine, params or {}
        self.catalog = engine.catalog
        self.spark = engine.spark

    # -- expressions

    def literal(self, v: Any) -> Column:
        if isinstance(v, int) and not isinstance(v, bool):
            return F.lit(v).cast("long") if -(2**63) <= v < 2**63 else F.lit(v).cast("decimal(38,0)")
        if isinstance(v, (list, tuple)):
            return F.array(*map(self.literal, v))
        if isinstance(v, dict):
            return F.struct(*(self.literal(x).alias(k) for k, x in v.items()))
        return F.lit(v)

    def column(self, scope: Scope, e: n.Expr, local: dict[str, Column] | None = None) -> Column:
        local = local or {}
        go = lambda x: self.column(scope, x, local)
        if isinstance(e, n.Lit):
            return self.literal(e.value)
        if isinstance(e, n.Param):
            if e.name not in self.params:
                raise BindError(f"no parameter ${e.name}")
            return self.literal(self.params[e.name])
        if isinstance(e, n.Var):
            if e.name in local:
                return local[e.name]
            return self.variable(scope, e.name)
        if isinstance(e, n.Prop):
            if isinstance(e.of, n.Var) and e.of.name not in local:
                b = scope.vars.get(e.of.name)
                if b is None:
                    raise BindError(f"{e.of.name} isn't in scope")
                if not isinstance(b, Value):
                    if e.name in b.props:
                        return F.col(b.props[e.name])
                    special = {"_id": getattr(b, "id", None), "_src": getattr(b, "src", None), "_dst": getattr(b, "dst", None)}.get(e.name)
                    if special is None:
                        raise BindError(f"{e.of.name} has no property {e.name}")
                    return F.col(special)
            return go(e.of).getField(e.name)
        if isinstance(e, n.Item):
            of, i = go(e.of), go(e.index)
            t = self.type_of(scope, of)
            if isinstance(t, T.StructType):
                return of.getField(e.index.value)
            return F.element_at(of, i if isinstance(t, T.MapType) else i.cast("int"))
        if isinstance(e, n.ListOf):
            return F.array(*map(go, e.items))
        if isinstance(e, n.MapOf):
            return F.struct(*(go(v).alias(k) for k, v in e.items))
        if isinstance(e, n.Case):
            out = None
            subject = go(e.subject) if e.subject is not None else None
            for when, then in e.branches:
                c = go(when) if subject is None else subject == go(when)
                out = F.when(c, go(then)) if out is None else out.when(c, go(then))
            return out.otherwise(go(e.default)) if e.default is not None else out
        if isinstance(e, n.Quantifier):
            of, test = go(e.of), lambda v: self.column(scope, e.where, {**local, e.var: v})
            if e.kind == "any":
                return F.exists(of, test)
            if e.kind == "all":
                return F.forall(of, test)
            if e.kind == "none":
                return ~F.exists(of, test)
            return F.size(F.filter(of, test)) == 1
        if isinstance(e, n.Op):
            if e.name == "in":
                return self.contained(scope, e, local)
            if e.name == "between":
                x, a, b = map(go, e.args)
                return (x >= a) & (x <= b)
            return SCALARS[e.name](self.context(scope), *map(go, e.args))
        if isinstance(e, n.Call):
            return self.call(scope, e, local)
        raise BindError(f"{type(e).__name__} can't stand here")

    def contained(self, scope: Scope, e: n.Op, local: dict[str, Column]) -> Column:
        x = self.column(scope, e.args[0], local)
        if isinstance(e.args[1], n.ListOf):
            items = e.args[1].items
            return x.isin(*[self.column(scope, i, local) for i in items]) if items else F.when(x.isNotNull(), F.lit(False))
        of = self.column(scope, e.args[1], local)
        return F.when(x.isNotNull(), F.array_contains(of, x))

    def call(self, scope: Scope, e: n.Call, local: dict[str, Column]) -> Column:
        go = lambda x: self.column(scope, x, local)
        if e.name in self.catalog.macros:
            params, body = self.catalog.macros[e.name]
            given = {p: e.args[i] if i < len(e.args) else d for i, (p, d) in enumerate(params)}
            if len(e.args) > len(params) or None in given.values():
                raise BindError(f"macro {e.name} takes {len(params)} arguments")
            return go(rebuild(body, lambda x: given.get(x.name) if isinstance(x, n.Var) else None))
        if e.name in ("list_transform", "list_filter", "list_apply"):
            body = e.args[1]
            f = lambda v: self.column(scope, body.body, {**local, body.var: v})
            return F.filter(go(e.args[0]), f) if e.name == "list_filter" else F.transform(go(e.args[0]), f)
        if e.name == "list_reduce":
            of, body = go(e.args[0]), e.args[1]
            free = [x.name for x in parts(body.body) if isinstance(x, n.Var) and x.name != body.var and x.name not in scope.vars and x.name not in local]
            other = free[0] if free else body.var
            return F.reduce(F.slice(of, 2, F.greatest(F.size(of) - 1, F.lit(0))), F.try_element_at(of, F.lit(1)), lambda a, v: self.column(scope, body.body, {**local, other: v, body.var: a}))
        if e.name in self.engine.functions:
            return self.engine.functions[e.name](*map(go, e.args))
        if e.name in AGGREGATES:
            raise BindError(f"the aggregate {e.name} can't stand here")
        if e.name not in SCALARS:
            raise BindError(f"no function {e.name}")
        if e.name == "set_seed" and isinstance(e.args[0], n.Lit):
            self.engine.seed = int(e.args[0].value)
        return SCALARS[e.name](self.context(scope), *map(go, e.args))

    def context(self, scope: Scope) -> Context:
        return Context(lambda c: self.type_of(scope, c), self.engine.seed, self.engine)

    def type_of(self, scope: Scope, c: Column) -> T.DataType:
        try:
            return (scope.df if scope.df is not None else self.one_row()).select(c.alias("x")).schema[0].dataType
        except AnalysisException:  # a lambda's variable has no type yet
            return T.DoubleType()

    def variable(self, scope: Scope, name: str) -> Column:
        b = scope.vars.get(name)
        if b is None:
            raise BindError(f"{name} isn't in scope")
        if isinstance(b, Value):
            return F.col(b.column)
        label = F.col(b.label_column) if isinstance(b, Node) and b.label_column else F.lit(b.label)
        first = [F.col(b.id).alias("_id")] if isinstance(b, Node) else [F.col(b.src).alias("_src"), F.col(b.dst).alias("_dst")]
        whole = F.struct(*first, label.alias("_label"), *(F.col(c).alias(k) for k, c in b.props.items()))
        return F.when(F.col(b.id if isinstance(b, Node) else b.src).isNotNull(), whole)

    def one_row(self) -> DataFrame:
        return self.spark.range(1).select(F.lit(1).alias("_one"))

    def base(self, scope: Scope) -> DataFrame:
        return scope.df if scope.df is not None else self.one_row()

    # -- patterns

    def scan_node(self, label: str, fts: tuple[str, str] | None = None) -> tuple[DataFrame, Node]:
        t = self.catalog.nodes.get(label)
        if t is None:
            raise BindError(f"no node table {label}")
        tag = next(_fresh)
        props = {c: f"{c}_{tag}" for c in t.columns}
        df = t.df
        if fts is not None:
            found = self.engine.fts_search(fts[0], fts[1])
            df = df.join(found.select(F.col("doc_id").alias("_f")), F.col(t.key) == F.col("_f"), "left_semi")
        return df.select(*(F.col(f"`{c}`").alias(props[c]) for c in t.columns)), Node(label, props[t.key], props)

    def scan_rel(self, label: str, direction: str) -> tuple[DataFrame, Rel, str, str]:
        """Edge rows, their binding, and the columns on which the near and the far node stand."""
        t = self.catalog.rels[label]
        tag = next(_fresh)
        props = {c: f"{c}_{tag}" for c in t.columns}
        src, dst, near, far = (f"{x}_{tag}" for x in ("src", "dst", "near", "far"))
        own = [F.col("_src").alias(src), F.col("_dst").alias(dst), *(F.col(f"`{c}`").alias(props[c]) for c in t.columns)]
        out, back = t.df.select(*own), t.df.select(*own)
        if direction == "out":
            return out, Rel(label, src, dst, props), src, dst
        if direction == "in":
            return out, Rel(label, src, dst, props), dst, src
        both = out.withColumn(near, F.col(src)).withColumn(far, F.col(dst)).unionByName(back.withColumn(near, F.col(dst)).withColumn(far, F.col(src)))
        return both, Rel(label, src, dst, props), near, far

    def fits(self, rel: RelTable, a: str, b: str, direction: str) -> str | None:
        """The direction in which rel leads from label a to b, if it does."""
        out, back = rel.source == a and rel.target == b, rel.source == b and rel.target == a
        if direction == "both":
            return "both" if out and back else "out" if out else "in" if back else None
        return direction if (out if direction == "out" else back) else None

    def choices(self, scope: Scope, p: n.Pattern) -> list[tuple[list[str], list[tuple[str, str]]]]:
        """All ways to give the pattern's nodes labels and its edges rel tables with directions."""
        given = []
        for x in p.nodes:
            bound = scope.vars.get(x.var) if x.var else None
            if bound is not None and not isinstance(bound, Node):
                raise BindError(f"{x.var} isn't a node")
            label = x.label or (bound.label if bound else None)
            if x.label and bound and bound.label and bound.label != x.label:
                raise BindError(f"{x.var} is a {bound.label}")
            if label and label not in self.catalog.nodes:
                raise BindError(f"no node table {label}")
            given.append([label] if label else sorted(self.catalog.nodes))
        for e in p.edges:
            if e.label and e.label not in self.catalog.rels:
                raise BindError(f"no rel table {e.label}")
        out: list[tuple[list[str], list[tuple[str, str]]]] = [([x], []) for x in given[0]]
        for i, e in enumerate(p.edges):
            rels = [self.catalog.rels[e.label]] if e.label else [self.catalog.rels[k] for k in sorted(self.catalog.rels)]
            out = [([*labels, b], [*es, (r.name, d)]) for labels, es in out for r in rels for b in given[i + 1] if (d := self.fits(r, labels[-1], b, e.direction))]
        same: dict[str, int] = {}
        for i, x in enumerate(p.nodes):  # a variable that stands twice has one label
            if x.var and x.var in same:
                out = [c for c in out if c[0][i] == c[0][same[x.var]]]
            elif x.var:
                same[x.var] = i
        if not out:
            raise BindError("no rel table fits the pattern")
        return out

    def match(self, scope: Scope, patterns: tuple[n.Pattern, ...], fts: tuple[str, str] | None = None) -> Scope:
        for p in patterns:
            ways = self.choices(scope, p)
            scopes = [self.chain(scope, p, labels, rels, fts) for labels, rels in ways]
            scope = scopes[0] if len(scopes) == 1 else self.together(scope, scopes)
        return scope

    def together(self, before: Scope, scopes: list[Scope]) -> Scope:
        """The union of one pattern's scopes under different labels."""
        names = [v for v in scopes[0].vars if v not in before.vars]
        tag, out, binding = next(_fresh), None, {}
        for v in names:
            bs = [s.vars[v] for s in scopes]
            if isinstance(bs[0], Value):
                binding[v] = Value(f"{v}_{tag}")
                continue
            props = {k: f"{v}_{k}_{tag}" for k in dict.fromkeys(k for b in bs for k in b.props)}
            binding[v] = Node(None, f"{v}_id_{tag}", props, f"{v}_label_{tag}") if isinstance(bs[0], Node) else Rel(None, f"{v}_src_{tag}", f"{v}_dst_{tag}", props)
        for s in scopes:
            cols = [F.col(c) for b in before.vars.values() for c in columns_of(b)]
            for v in names:
                b, to = s.vars[v], binding[v]
                if isinstance(b, Value):
                    cols.append(F.col(b.column).alias(to.column))
                    continue
                cols += [F.col(b.props[k]).alias(c) for k, c in to.props.items() if k in b.props]
                if isinstance(b, Node):
                    cols += [F.col(b.id).cast("string").alias(to.id), (F.col(b.label_column) if b.label_column else F.lit(b.label)).alias(to.label_column)]
                else:
                    cols += [F.col(b.src).cast("string").alias(to.src), F.col(b.dst).cast("string").alias(to.dst)]
            x = s.df.select(*cols)
            out = x if out is None else out.unionByName(x, allowMissingColumns=True)
        return Scope(out, {**before.vars, **binding})

    def chain(self, scope: Scope, p: n.Pattern, labels: list[str], rels: list[tuple[str, str]], fts: tuple[str, str] | None = None) -> Scope:
        start = next((i for i, x in enumerate(p.nodes) if x.var and x.var in scope.vars), None)
        names = [x.var or f"_anonymous{next(_fresh)}" for x in p.nodes]
        if start is None:
            start = 0
            df, b = self.scan_node(labels[0], fts)
            df = self.filtered(Scope(df, {names[0]: b}), names[0], p.nodes[0], scope)
            scope = scope.with_(df if scope.df is None else scope.df.crossJoin(df), **{names[0]: b})
        scope = self.by_props(scope, names[start], p.nodes[start])
        for i in range(start, len(p.edges)):
            scope = self.extend(scope, names[i], p.edges[i], rels[i], names[i + 1], p.nodes[i + 1], labels[i + 1])
        turn = {"out": "in", "in": "out", "both": "both"}
        for i in range(start - 1, -1, -1):
            e = replace(p.edges[i], direction=turn[p.edges[i].direction])
            scope = self.extend(scope, names[i + 1], e, (rels[i][0], turn[rels[i][1]]), names[i], p.nodes[i], labels[i])
        return Scope(scope.df, {k: v for k, v in scope.vars.items() if not k.startswith("_anonymous")})

    def filtered(self, own: Scope, var: str, x: n.NodePattern, outer: Scope) -> DataFrame:
        """A scan under the pattern's properties that need nothing from outside."""
        df = own.df
        for k, v in x.props:
            if isinstance(v, (n.Lit, n.Param)):
                df = df.filter(self.column(own, n.Prop(n.Var(var), k)) == self.column(own, v))
        return df

    def by_props(self, scope: Scope, var: str, x: n.NodePattern | n.EdgePattern) -> Scope:
        for k, v in x.props:
            if not isinstance(v, (n.Lit, n.Param)) or isinstance(x, n.EdgePattern) or x.var in scope.vars:
                scope = Scope(scope.df.filter(self.column(scope, n.Prop(n.Var(var), k)) == self.column(scope, v)), scope.vars)
        return scope

    def extend(self, scope: Scope, near: str, e: n.EdgePattern, rel: tuple[str, str], far: str, x: n.NodePattern, label: str) -> Scope:
        a = scope.vars[near]
        if e.hops is not None:
            return self.extend_far(scope, a, e, rel, far, x, label)
        edges, binding, on_near, on_far = self.scan_rel(*rel)
        at = F.col(a.id)
        if a.label is None:
            table = self.catalog.rels[rel[0]]
            edges = edges.withColumn(on_near + "_l", F.lit(table.source if rel[1] == "out" else table.target))
        cond = at == F.col(on_near)
        if a.label is None and a.label_column:
            cond = (at == F.col(on_near).cast("string")) & (F.col(a.label_column) == F.col(on_near + "_l"))
        bound = scope.vars.get(far)
        if e.var and e.var in scope.vars:
            old = scope.vars[e.var]
            cond &= (F.col(old.src) == F.col(binding.src)) & (F.col(old.dst) == F.col(binding.dst))
        if isinstance(bound, Node):
            cond &= F.col(bound.id) == (F.col(on_far) if bound.label else F.col(on_far).cast("string"))
        out = scope.with_(scope.df.join(edges, cond), **({e.var: binding} if e.var else {}))
        name = e.var or f"_anonymous{next(_fresh)}"
        if not e.var and e.props:
            out = out.with_(out.df, **{name: binding})
        out = self.by_props(out, name, e)
        if isinstance(bound, Node):
            return self.by_props(out, far, x)
        if x.var is None and not x.props:
            # edges end at nodes that exist, so a node that nothing else is asked of needs no join
            return out.with_(out.df, **{far: Node(label, on_far, {self.catalog.nodes[label].key: on_far})})
        df, b = self.scan_node(label)
        df = self.filtered(Scope(df, {far: b}), far, x, out)
        out = out.with_(out.df.join(df, F.col(on_far) == F.col(b.id)), **{far: b})
        return self.by_props(out, far, x)

    def extend_far(self, scope: Scope, a: Node, e: n.EdgePattern, rel: tuple[str, str], far: str, x: n.NodePattern, label: str) -> Scope:
        table = self.catalog.rels[rel[0]]
        low, high = e.hops
        if (high is None or high > 1) and table.source != table.target:
            raise BindError("a path of several hops needs a rel table from a label to itself")
        edges = table.df
        for k, v in e.props:
            edges = edges.filter(F.col(k) == self.column(Scope(edges), v))
        edges = traverse.oriented(edges, rel[1], apart=e.mode == "trail")
        sources = scope.df.select(F.col(a.id).alias("id"))
        found = traverse.reach(sources, edges, low, high) if e.mode == "reach" else traverse.walks(sources, edges, low, traverse.MOST_HOPS if high is None else high, e.mode)
        tag = next(_fresh)
        path, s, d = f"path_{tag}", f"path_src_{tag}", f"path_dst_{tag}"
        whole = F.struct(F.col("nodes").alias("_nodes"), F.col("rels").alias("_rels"), F.col("length").alias("_length"), F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.col("length").cast("double").alias("_cost"))
        found = found.select(F.col("src").alias(s), F.col("dst").alias(d), whole.alias(path))
        cond = F.col(a.id) == F.col(s)
        bound = scope.vars.get(far)
        if isinstance(bound, Node):
            cond &= F.col(bound.id) == F.col(d)
        out = scope.with_(scope.df.join(found, cond), **({e.var: Value(path)} if e.var else {}))
        if isinstance(bound, Node):
            return out
        df, b = self.scan_node(label)
        df = self.filtered(Scope(df, {far: b}), far, x, out)
        out = out.with_(out.df.join(df, F.col(d) == F.col(b.id)), **{far: b})
        return self.by_props(out, far, x)

    def shared(self, a: Scope, patterns: tuple[n.Pattern, ...]) -> list[str]:
        names = [x.var for p in patterns for x in p.nodes if x.var]
        return [v for v in dict.fromkeys(names) if isinstance(a.vars.get(v), Node)]

    def apart(self, scope: Scope, patterns: tuple[n.Pattern, ...]) -> tuple[Scope, list[str]]:
        """The patterns matched on their own, with the variables that they share with scope; labels carry over."""
        shared = self.shared(scope, patterns)

        def labelled(x: n.NodePattern) -> n.NodePattern:
            b = scope.vars.get(x.var) if x.var else None
            return replace(x, label=b.label) if isinstance(b, Node) and b.label and not x.label else x

        own = tuple(replace(p, nodes=tuple(map(labelled, p.nodes))) for p in patterns)
        return self.match(Scope(None), own), shared

    def optional(self, scope: Scope, m: n.Match) -> Scope:
        right, shared = self.apart(scope, m.patterns)
        both = Scope(None, {**right.vars, **scope.vars})
        cond = F.lit(True)
        for v in shared:
            cond &= F.col(scope.vars[v].id) == F.col(right.vars[v].id)
        if m.where is not None:
            # types are asked of the joined columns
            probe = Scope(scope.df.join(right.df), both.vars)
            cond &= self.column(probe, m.where)
        df = scope.df.join(right.df, cond, "left")
        return Scope(df, {**right.vars, **scope.vars})

    def exists(self, scope: Scope, q: n.Query) -> tuple[Scope, Column, list[str]]:
        """The inner match, and the condition under which it belongs to an outer row."""
        matches = [c for c in q.clauses if isinstance(c, n.Match)]
        if not matches or len(matches) < len([c for c in q.clauses if not (isinstance(c, n.Projection) and c.final)]):
            raise BindError("EXISTS takes MATCH clauses")
        patterns = tuple(p for m in matches for p in m.patterns)
        right, shared = self.apart(scope, patterns)
        cond = F.lit(True)
        for v in shared:
            cond &= F.col(scope.vars[v].id) == F.col(right.vars[v].id)
        probe = Scope(self.base(scope).join(right.df), {**right.vars, **scope.vars})
        for m in matches:
            for c in conjuncts(m.where):
                if isinstance(c, n.Exists):
                    right = self.where(right, c)
                else:
                    cond &= self.column(probe, c)
        return right, cond, shared

    def where(self, scope: Scope, e: n.Expr | None) -> Scope:
        df = self.base(scope)
        for c in conjuncts(e):
            negated = isinstance(c, n.Op) and c.name == "not" and isinstance(c.args[0], n.Exists)
            if isinstance(c, n.Exists) or negated:
                right, cond, _ = self.exists(Scope(df, scope.vars), (c.args[0] if negated else c).query)
                df = df.join(right.df, cond, "left_anti" if negated else "left_semi")
            elif any(isinstance(x, n.Exists) for x in parts(c)):
                df = self.flagged(Scope(df, scope.vars), c)
            else:
                own = Scope(df, scope.vars)
                col = self.column(own, c)
                if not isinstance(self.type_of(own, col), (T.BooleanType, T.NullType)):
                    raise BindError("WHERE needs a boolean")
                df = df.filter(col)
        return Scope(df, scope.vars)

    def flagged(self, scope: Scope, c: n.Expr) -> DataFrame:
        """A filter in which EXISTS stands below OR and the like: each becomes a column by a left join on its keys."""
        df, marks = scope.df, {}
        for x in {x for x in parts(c) if isinstance(x, n.Exists)}:
            right, cond, shared = self.exists(Scope(df, scope.vars), x.query)
            mark = f"exists_{next(_fresh)}"
            # rows are told apart by the columns of all outer variables that the inner query names
            named = {y.name for c2 in x.query.clauses if isinstance(c2, n.Match) for y in parts((c2.where, tuple(v for p in c2.patterns for e in (*p.nodes, *p.edges) for _, v in e.props))) if isinstance(y, n.Var)}
            keys = list(dict.fromkeys(k for v, b in scope.vars.items() if v in named or v in shared for k in columns_of(b)))
            own = df.join(right.df, cond, "left_semi").select(*(F.col(k).alias(f"{mark}_{i}") for i, k in enumerate(keys)), F.lit(True).alias(mark)).distinct()
            on = F.lit(True)
            for i, k in enumerate(keys):
                on &= F.col(k).eqNullSafe(F.col(f"{mark}_{i}"))
            df = df.join(own, on, "left").drop(*(f"{mark}_{i}" for i in range(len(keys))))
            marks[x] = mark
        vars_ = {**scope.vars, **{m: Value(m) for m in marks.values()}}
        flat = rebuild(c, lambda x: n.Call("coalesce", (n.Var(marks[x]), n.Lit(False))) if isinstance(x, n.Exists) else None)
        return df.filter(self.column(Scope(df, vars_), flat)).drop(*marks.values())

    # -- counting

    def tallied(self, m: n.Match, p: n.Projection) -> tuple[Scope, n.Projection] | None:
        """The match and a projection that only counts rows, without making the rows that it counts.

        Where the patterns form a tree, what hangs from a node and isn't asked for is counted by that node before the
        join; COUNT(*) becomes the sum of the products. A hub's branches then cost what they hold, not all combinations.
        None where this doesn't apply.
        """
        exprs = [e for e, *_ in p.items] + [e for e, _ in p.order if isinstance(e, n.Expr)]
        calls = [x for e in exprs for x in parts(e) if is_aggregate(x)]
        wheres = conjuncts(m.where)
        if m.fts or p.everything or not calls or any(x.name != "count" or x.args and not x.star for x in calls) or any(isinstance(x, n.Exists) for e in (*exprs, *wheres) for x in parts(e)):
            return None
        tree = self.tree(m.patterns)
        if tree is None:
            return None
        points, links = tree
        ends = {e.var: {u, v} for u, e, v in links if e.var}
        named = lambda e: {x.name for x in parts(e) if isinstance(x, n.Var)} & {*points, *ends}
        asked = {v for e in exprs for v in named(e)} | {v for c in wheres if len(named(c)) > 1 for v in named(c)}
        kept = {x for v in asked for x in ends.get(v, {v})} or {max(points, key=lambda v: sum(v in (a, b) for a, _, b in links))}
        left = list(links)
        while leaf := next((k for k in left for a in (k[0], k[2]) if a not in kept and sum(a in (x, y) for x, _, y in left) == 1), None):
            left.remove(leaf)
        gone = [k for k in links if k not in left]
        if not gone:
            return None
        kept |= {v for u, _, w in left for v in (u, w)}

        def local(scope: Scope, var: str | None) -> Scope:
            for c in wheres:
                if var is not None and named(c) == {var}:
                    scope = self.where(scope, c)
            return scope

        def tally(u: str, k: tuple, column: str) -> tuple[DataFrame, str]:
            """(near, column): how many ways there are through link k for each node at its end u."""
            a, e, b = k
            v = b if u == a else a
            turn = {"out": "in", "in": "out", "both": "both"}
            way = self.fits(self.catalog.rels[e.label], points[u].label, points[v].label, e.direction if u == a else turn[e.direction])
            edges, binding, near, far = self.scan_rel(e.label, way)
            scope = local(self.by_props(Scope(edges, {e.var or "_edge": binding}), e.var or "_edge", e), e.var)
            df, x, below = scope.df, points[v], [j for j in gone if j != k and v in (j[0], j[2])]
            if not x.var.startswith(" ") or x.props or below:
                nodes, node = self.scan_node(x.label)
                own = Scope(nodes, {v: node})
                own, weights = branches(local(Scope(self.filtered(own, v, x, own), own.vars), v), v, below)
                df = df.join(own.df, F.col(far) == F.col(node.id))
            else:
                weights = []
            return df.groupBy(near).agg((F.sum(self.product(weights)) if weights else F.count(F.lit(1))).alias(column)), near

        def branches(scope: Scope, u: str, below: list[tuple]) -> tuple[Scope, list[str]]:
            weights = []
            for k in below:
                w = f"ways_{next(_fresh)}"
                df, near = tally(u, k, w)
                scope = Scope(scope.df.join(df, F.col(scope.vars[u].id) == F.col(near)), scope.vars)
                weights.append(w)
            return scope, weights

        patterns = [n.Pattern((points[u], points[v]), (e,)) for u, e, v in left] or [n.Pattern((points[next(iter(kept))],))]
        scope = Scope(None)
        while patterns:  # each touches what is already there
            i = next(i for i, x in enumerate(patterns) if not scope.vars or any(y.var in scope.vars for y in x.nodes))
            scope = self.match(Scope(scope.df, scope.vars), (patterns.pop(i),))
        for c in wheres:
            if not named(c) or named(c) <= {*kept, *(e.var for _, e, _ in left)}:
                scope = self.where(scope, c)
        weights = []
        for u in sorted(kept):
            scope, more = branches(scope, u, [k for k in gone if u in (k[0], k[2])])
            weights += more
        total = f"_ways{next(_fresh)}"
        scope = scope.with_(scope.df.withColumn(total, self.product(weights)), **{total: Value(total)})
        count = n.Call("coalesce", (n.Call("sum", (n.Var(total),)), n.Lit(0)))
        swap = lambda e: rebuild(e, lambda x: count if is_aggregate(x) else None)
        items = tuple((swap(e), alias, text) for e, alias, text in p.items)
        return scope, replace(p, items=items, order=tuple((swap(e), asc) for e, asc in p.order))

    def product(self, columns: list[str]) -> Column:
        out = F.col(columns[0])
        for c in columns[1:]:
            out = out * F.col(c)
        return out

    def tree(self, patterns: tuple[n.Pattern, ...]) -> tuple[dict[str, n.NodePattern], list[tuple[str, n.EdgePattern, str]]] | None:
        """The patterns' nodes by variable and their links, if all labels are given and the links form one tree."""
        points: dict[str, n.NodePattern] = {}
        links: list[tuple[str, n.EdgePattern, str]] = []
        for p in patterns:
            names = [x.var or f" {next(_fresh)}" for x in p.nodes]  # no text has such a name
            for name, x in zip(names, p.nodes, strict=True):
                old = points.get(name, n.NodePattern(name, None))
                if x.label and old.label and x.label != old.label:
                    return None
                points[name] = n.NodePattern(name, old.label or x.label, (*old.props, *x.props))
            links += [(a, e, b) for a, e, b in zip(names, p.edges, names[1:])]
        given = [v for x in (*points.values(), *(e for _, e, _ in links)) for _, v in x.props]
        rels = [e.var for _, e, _ in links if e.var]
        if len(links) < 2 or len(links) != len(points) - 1 or not all(isinstance(v, (n.Lit, n.Param)) for v in given) or len({*rels, *points}) < len(rels) + len(points):
            return None
        if any(x.label not in self.catalog.nodes for x in points.values()) or any(e.hops is not None or e.label not in self.catalog.rels for _, e, _ in links):
            return None
        if any(self.fits(self.catalog.rels[e.label], points[a].label, points[b].label, e.direction) is None for a, e, b in links):
            return None
        seen = {next(iter(points))}
        while more := {v for a, _, b in links for v in (a, b) if {a, b} & seen} - seen:
            seen |= more
        return (points, links) if len(seen) == len(points) else None

    # -- projections

    def project(self, scope: Scope, p: n.Projection) -> Scope:
        items = [(e, alias or text) for e, alias, text in p.items]
        if p.everything:
            items = [(n.Var(v), v) for v in scope.vars if not v.startswith("_")] + items
        if not items:
            raise BindError("nothing to return")
        grouped = any(has_aggregate(e) for e, _ in items)
        order = list(p.order)
        known = dict(items) and {e: name for e, name in items}
        order = [(rebuild(e, lambda x: n.Var(known[x]) if x in known and not isinstance(x, n.Lit) else None) if isinstance(e, n.Expr) else e, asc) for e, asc in order]
        if grouped or any(has_aggregate(e) for e, _ in order):
            scope, items, order = self.group(scope, items, order)
        df = self.base(scope)
        scope = Scope(df, scope.vars)
        out: dict[str, Binding] = {}
        adds: dict[str, Column] = {}
        for e, name in items:
            b = scope.vars.get(e.name) if isinstance(e, n.Var) else None
            if not p.final and isinstance(b, (Node, Rel)):
                out[name] = b
                continue
            c = f"out_{next(_fresh)}"
            adds[c] = self.column(scope, e)
            out[name] = Value(c)
        df = df.select("*", *(v.alias(k) for k, v in adds.items()))
        keep = list(dict.fromkeys(c for b in out.values() for c in columns_of(b)))
        if p.distinct:
            df = df.select(*keep).distinct()
        if order:
            wide = Scope(df, {**({} if p.distinct else scope.vars), **out})
            # an alias may hide a node or edge, but not its properties
            for e in {x for k, _ in order for x in parts(k) if isinstance(x, n.Prop) and isinstance(x.of, n.Var)}:
                old = scope.vars.get(e.of.name)
                if not p.distinct and isinstance(old, (Node, Rel)) and isinstance(out.get(e.of.name), Value) and e.name in old.props:
                    own = f"_hidden_{e.of.name}_{e.name}"
                    wide = Scope(df, {**wide.vars, own: Value(old.props[e.name])})
                    order = [(rebuild(k, lambda x, e=e, own=own: n.Var(own) if x == e else None), asc) for k, asc in order]
            keys = [self.column(wide, e) for e, _ in order]
            df = df.orderBy(*(k.asc_nulls_last() if asc else k.desc_nulls_first() for k, (_, asc) in zip(keys, order, strict=True)))
        if p.skip is not None:
            df = df.offset(self.number(p.skip))
        if p.limit is not None:
            df = df.limit(self.number(p.limit))
        result = Scope(df.select(*keep), out)
        return self.where(result, p.where) if p.where is not None else result

    def number(self, e: n.Expr) -> int:
        v = e.value if isinstance(e, n.Lit) else self.params.get(e.name) if isinstance(e, n.Param) else None
        if not isinstance(v, int) or v < 0:
            raise BindError("LIMIT and SKIP need a whole number")
        return v

    def group(self, scope: Scope, items: list, order: list) -> tuple[Scope, list, list]:
        """Implicit grouping: what isn't aggregated is a key; aggregates inside expressions are lifted out."""
        df = self.base(scope)
        keys: dict[n.Expr, str] = {}
        calls: dict[n.Call, str] = {}
        bindings: dict[str, Binding] = {}

        def key(e: n.Expr) -> n.Expr:
            if isinstance(e, n.Lit):
                return e
            if isinstance(e, n.Var) and isinstance(scope.vars.get(e.name), (Node, Rel)):
                bindings[e.name] = scope.vars[e.name]
                return e
            name = keys.setdefault(e, f"key_{next(_fresh)}")
            bindings[name] = Value(name)
            return n.Var(name)

        def lift(e: Any) -> Any:
            if is_aggregate(e):
                name = calls.setdefault(e, f"agg_{next(_fresh)}")
                bindings[name] = Value(name)
                return n.Var(name)
            if isinstance(e, n.Expr) and not has_aggregate(e):
                return key(e)
            return None

        out = [(rebuild(e, lift), name) for e, name in items]
        aliases = {name for _, name in items}
        later = [(e if isinstance(e, n.Var) and e.name in aliases else rebuild(e, lambda x: x if isinstance(x, n.Var) and x.name in aliases else lift(x)), asc) for e, asc in order]
        own = Scope(df, scope.vars)
        by = [self.column(own, e).alias(name) for e, name in keys.items()]
        carried = list(dict.fromkeys(c for b in bindings.values() if not isinstance(b, Value) for c in columns_of(b)))
        args, aggs = [], []
        for c, name in calls.items():
            if c.star or not c.args:
                aggs.append(F.count(F.lit(1)).alias(name))
                continue
            arg = f"arg_{name}"
            args.append(self.column(own, c.args[0]).alias(arg))
            aggs.append(AGGREGATES[c.name](arg, c.distinct).alias(name))
        pre = df.select(*carried, *by, *args) if carried or by or args else df
        grouped = pre.groupBy(*carried, *keys.values()).agg(*aggs) if aggs else pre.distinct()
        return Scope(grouped, bindings), out, later

    # -- clauses

    def query(self, q: Any) -> DataFrame:
        if isinstance(q, n.Union):
            a, b = self.query(q.left), self.query(q.right)
            if len(a.columns) != len(b.columns):
                raise BindError("UNION needs equally many columns")
            out = a.union(b)
            return out if q.all else out.distinct()
        scope = self.clauses(Scope(None), q.clauses)
        last = q.clauses[-1]
        if isinstance(last, n.Projection) and last.final or isinstance(last, (n.CallClause, n.Load)):
            return scope.df.select(*(F.col(b.column).alias(v) for v, b in scope.vars.items()))
        if any(isinstance(c, (n.Create, n.SetItems, n.Delete, n.Merge, n.Foreach)) for c in q.clauses):
            return self.engine.message(f"{self.engine.changed} rows changed")
        raise BindError("a query ends with RETURN or an update")

    def clauses(self, scope: Scope, clauses: tuple[Any, ...]) -> Scope:
        from meshwork.plans import updates

        waiting = list(clauses)
        while waiting:
            c = waiting.pop(0)
            if isinstance(c, n.Match):
                plain = scope.df is None and not c.optional and waiting and isinstance(waiting[0], n.Projection)
                if plain and (counted := self.tallied(c, waiting[0])):
                    scope, waiting[0] = counted
                elif c.optional and scope.df is not None:
                    scope = self.optional(scope, c)
                elif c.optional:
                    scope = self.optional(Scope(self.one_row()), c)
                else:
                    scope = self.where(self.match(scope, c.patterns, c.fts), c.where)
            elif isinstance(c, n.Unwind):
                df, name = self.base(scope), f"{c.var}_{next(_fresh)}"
                own = Scope(df, scope.vars)
                scope = scope.with_(df.withColumn(name, F.explode(self.column(own, c.expr))), **{c.var: Value(name)})
            elif isinstance(c, n.Projection):
                scope = self.project(scope, c)
            elif isinstance(c, (n.CallClause, n.Load)):
                df = self.engine.call(c.name, [self.constant(a) for a in c.args]) if isinstance(c, n.CallClause) else self.engine.load(c.path, dict(c.options))
                tag = next(_fresh)
                names = {x: f"{x}_{tag}" for x in df.columns}
                df = df.select(*(F.col(f"`{x}`").alias(y) for x, y in names.items()))
                scope = scope.with_(df if scope.df is None else scope.df.crossJoin(df), **{x: Value(y) for x, y in names.items()})
            else:
                scope = updates.apply(self, scope, c)
        return scope

    def constant(self, e: n.Expr) -> Any:
        if isinstance(e, n.Lit):
            return e.value
        if isinstance(e, n.Param):
            return self.params[e.name]
        if isinstance(e, n.ListOf):
            return [self.constant(x) for x in e.items]
        if isinstance(e, n.Var):
            return e.name
        return self.one_row().select(self.column(Scope(None), e)).first()[0]


def node_struct(t: NodeTable) -> list[str]:
    return t.columns
