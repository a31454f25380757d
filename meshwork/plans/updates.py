"""CREATE, SET, DELETE, MERGE and FOREACH: each makes new versions of tables; old ones stay as they were."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.operators.tables import CatalogError, NodeTable, RelTable
from meshwork.plans import nodes as n
from meshwork.plans.lineage import settled

if TYPE_CHECKING:
    from meshwork.plans.lower import Lowering, Scope


def store(low: Lowering, table: NodeTable | RelTable, df: DataFrame, changed: int) -> None:
    """Puts a new version, computed now: later clauses see it, and its plan doesn't grow with each update."""
    low.engine.changed += changed
    cls = NodeTable(table.name, table.key, df, table.serial) if isinstance(table, NodeTable) else RelTable(table.name, table.source, table.target, df)
    low.catalog.put(cls)


def append(low: Lowering, table: NodeTable | RelTable, rows: DataFrame) -> None:
    n_new = rows.count()
    store(low, table, settled(table.df.unionByName(rows)), n_new)


def insert_nodes(low: Lowering, label: str, rows: DataFrame) -> DataFrame:
    """Adds rows (some of the label's columns) after checking keys; gives the whole rows."""
    t = low.catalog.nodes.get(label)
    if t is None:
        raise CatalogError(f"no node table {label}")
    unknown = set(rows.columns) - set(t.columns)
    if unknown:
        raise CatalogError(f"{label} has no column {sorted(unknown)[0]}")
    kinds = {f.name: f.dataType for f in t.df.schema}
    if t.serial and t.serial not in rows.columns:
        top = t.df.agg(F.max(t.serial)).first()[0]
        rows = rows.withColumn(t.serial, F.lit((0 if top is None else top + 1)) + F.monotonically_increasing_id()) if rows.count() == 1 else low.engine.numbered(rows, t.serial, 0 if top is None else top + 1)
    whole = settled(rows.select(*((F.col(f"`{c}`").cast(kinds[c]) if c in rows.columns else F.lit(None).cast(kinds[c])).alias(c) for c in t.columns)))
    bad = whole.agg(F.count_if(F.col(t.key).isNull()).alias("nulls"), (F.count("*") - F.count_distinct(t.key)).alias("twice")).first()
    if bad["nulls"]:
        raise CatalogError(f"{label} needs a value for its key {t.key}")
    if bad["twice"] or not whole.join(t.df.select(t.key), t.key, "left_semi").isEmpty():
        raise CatalogError(f"{label} has a row with that {t.key} already")
    append(low, t, whole)
    return whole


def create(low: Lowering, scope: Scope, patterns: tuple[n.Pattern, ...]) -> Scope:
    from meshwork.plans.lower import Node, Rel, Scope, _fresh

    df = settled(low.base(scope))
    scope = Scope(df, scope.vars)
    for p in patterns:
        names = []
        for x in p.nodes:
            if x.var and isinstance(scope.vars.get(x.var), Node):
                names.append(x.var)
                continue
            if not x.label:
                raise CatalogError("a new node needs a label")
            t = low.catalog.nodes.get(x.label)
            if t is None:
                raise CatalogError(f"no node table {x.label}")
            var, tag = x.var or f"_new{next(_fresh)}", next(_fresh)
            for k, _ in x.props:
                if k not in t.columns:
                    raise CatalogError(f"{x.label} has no column {k}")
            kinds = {f.name: f.dataType for f in t.df.schema}
            cols = {k: low.column(scope, v).cast(kinds[k]) for k, v in x.props}
            if t.serial and t.serial not in cols:
                top = t.df.agg(F.max(t.serial)).first()[0]
                start = 0 if top is None else top + 1
                df = low.engine.numbered(scope.df, f"{t.serial}_{tag}", start)
                cols[t.serial] = F.col(f"{t.serial}_{tag}").cast(kinds[t.serial])
                scope = Scope(df.withColumnRenamed(f"{t.serial}_{tag}", f"_serial_{tag}"), scope.vars)
                cols[t.serial] = F.col(f"_serial_{tag}").cast(kinds[t.serial])
            props = {c: f"{c}_{tag}" for c in t.columns}
            df = settled(scope.df.select("*", *(cols.get(c, F.lit(None).cast(kinds[c])).alias(props[c]) for c in t.columns)))
            insert_nodes(low, x.label, df.select(*(F.col(props[c]).alias(c) for c in t.columns)))
            scope = Scope(df, {**scope.vars, var: Node(x.label, props[t.key], props)})
            names.append(var)
        for i, e in enumerate(p.edges):
            a, b = scope.vars[names[i]], scope.vars[names[i + 1]]
            if e.direction == "in":
                a, b = b, a
            t = low.catalog.rels.get(e.label or "")
            if t is None:
                raise CatalogError(f"no rel table {e.label}")
            if (t.source, t.target) != (a.label, b.label):
                raise CatalogError(f"{t.name} leads from {t.source} to {t.target}")
            kinds = {f.name: f.dataType for f in t.df.schema}
            tag = next(_fresh)
            given = {k: low.column(scope, v).cast(kinds[k]) for k, v in e.props}
            props = {c: f"{c}_{tag}" for c in t.columns}
            df = scope.df.select("*", F.col(a.id).alias(f"src_{tag}"), F.col(b.id).alias(f"dst_{tag}"), *(given.get(c, F.lit(None).cast(kinds[c])).alias(props[c]) for c in t.columns))
            append(low, t, df.select(F.col(f"src_{tag}").alias("_src"), F.col(f"dst_{tag}").alias("_dst"), *(F.col(props[c]).alias(c) for c in t.columns)))
            scope = Scope(df, {**scope.vars, **({e.var: Rel(t.name, f"src_{tag}", f"dst_{tag}", props)} if e.var else {})})
    return Scope(scope.df, {k: v for k, v in scope.vars.items() if not k.startswith("_new")})


def set_items(low: Lowering, scope: Scope, items: tuple[tuple[n.Expr, n.Expr], ...]) -> Scope:
    """All values come from the rows before the update; of rows that name one element, one decides."""
    from meshwork.plans.lower import Node, Rel, Scope, _fresh

    changes: dict[str, dict[str, Any]] = {}
    for target, value in items:
        if not isinstance(target, n.Prop) or not isinstance(target.of, n.Var):
            raise CatalogError("SET changes a property of a variable")
        changes.setdefault(target.of.name, {})[target.name] = value
    df, renamed = scope.df, {}
    for var, values in changes.items():
        b = scope.vars.get(var)
        if not isinstance(b, (Node, Rel)) or b.label is None:
            raise CatalogError(f"{var} isn't a node or edge of one table")
        t = low.catalog.table(b.label)
        kinds = {f.name: f.dataType for f in t.df.schema}
        for k, v in values.items():
            if k not in b.props:
                raise CatalogError(f"{t.name} has no column {k}")
            tag = f"set_{next(_fresh)}"
            renamed[(var, k)] = (tag, low.column(scope, v).cast(kinds[k]))
    df = settled(df.select("*", *(c.alias(tag) for tag, c in renamed.values())))
    bindings = dict(scope.vars)
    for var, values in changes.items():
        b = scope.vars[var]
        t = low.catalog.table(b.label)
        pairs = [("_k", t.key, b.id)] if isinstance(b, Node) else [("_ks", "_src", b.src), ("_kd", "_dst", b.dst), *((f"_k{i}", c, b.props[c]) for i, c in enumerate(t.columns))]
        new = df.filter(F.col(pairs[0][2]).isNotNull()).select(*(F.col(c).alias(k) for k, _, c in pairs), *(F.col(renamed[(var, k)][0]).alias(f"_v_{k}") for k in values)).dropDuplicates([k for k, _, _ in pairs])
        new = settled(new)
        cond = F.lit(True)
        for k, own, _ in pairs:
            cond &= F.col(f"`{own}`").eqNullSafe(F.col(k))
        joined = t.df.join(new.withColumn("_hit", F.lit(True)), cond, "left")
        out = joined.select(*((F.when(F.col("_hit"), F.col(f"_v_{c}")).otherwise(F.col(f"`{c}`")).alias(c) if c in values else F.col(f"`{c}`")) for c in t.df.columns))
        out = settled(out)
        if isinstance(t, NodeTable) and t.key in values:
            bad = out.agg(F.count_if(F.col(t.key).isNull()), F.count("*") - F.count_distinct(t.key)).first()
            if bad[0] or bad[1]:
                raise CatalogError(f"{t.name}'s key {t.key} would be null or repeated")
        store(low, t, out, new.count())
        props = {**b.props, **{k: renamed[(var, k)][0] for k in values}}
        bindings[var] = Node(b.label, props[t.key], props) if isinstance(b, Node) else Rel(b.label, b.src, b.dst, props)
    return Scope(df, bindings)


def delete(low: Lowering, scope: Scope, exprs: tuple[n.Expr, ...], detach: bool) -> Scope:
    from meshwork.plans.lower import Node, Rel, Scope

    df = settled(scope.df)
    rels = [e for e in exprs if isinstance(e, n.Var) and isinstance(scope.vars.get(e.name), Rel)]
    for e in [*rels, *(e for e in exprs if e not in rels)]:
        b = scope.vars.get(e.name) if isinstance(e, n.Var) else None
        if isinstance(b, Rel):
            t = low.catalog.rels[b.label]
            pairs = [("_src", b.src), ("_dst", b.dst), *((c, b.props[c]) for c in t.columns)]
        elif isinstance(b, Node) and b.label:
            t = low.catalog.nodes[b.label]
            pairs = [(t.key, b.id)]
        else:
            raise CatalogError("DELETE takes nodes or edges of one table")
        gone = settled(df.filter(F.col(pairs[0][1]).isNotNull()).select(*(F.col(c).alias(f"_g{i}") for i, (_, c) in enumerate(pairs))).distinct())
        if isinstance(b, Node):
            for r in list(low.catalog.rels.values()):
                for end, label in (("_src", r.source), ("_dst", r.target)):
                    if label != b.label:
                        continue
                    if detach:
                        r = low.catalog.rels[r.name]
                        store(low, r, settled(r.df.join(gone, F.col(end) == F.col("_g0"), "left_anti")), 0)
                    elif not r.df.join(gone, F.col(end) == F.col("_g0"), "left_semi").isEmpty():
                        raise CatalogError(f"{b.label} still has {r.name} edges; use DETACH DELETE")
        cond = F.lit(True)
        for i, (own, _) in enumerate(pairs):
            cond &= F.col(f"`{own}`").eqNullSafe(F.col(f"_g{i}"))
        store(low, t, settled(t.df.join(gone, cond, "left_anti")), gone.count())
    return Scope(df, scope.vars)


def merge(low: Lowering, scope: Scope, m: n.Merge) -> Scope:
    """Each pattern is matched as a whole; rows without a match create it."""
    from meshwork.plans.lower import Node, Scope

    for p in m.patterns:
        base = settled(low.base(scope))
        scope = Scope(base, scope.vars)
        row = low.engine.numbered(base, "_row", 0) if scope.vars else base.withColumn("_row", F.lit(0).cast("long"))
        outer = Scope(settled(row), scope.vars)
        matched = low.match(outer, (p,))
        matched = Scope(settled(matched.df), matched.vars)
        missing = outer.df.join(matched.df.select(F.col("_row").alias("_m")).distinct(), F.col("_row") == F.col("_m"), "left_anti")
        missing = settled(missing)
        new_vars = [x.var for x in (*p.nodes, *p.edges) if x.var and x.var not in scope.vars]
        if m.on_match and not matched.df.isEmpty():
            matched = set_items(low, matched, m.on_match)
        if not missing.isEmpty():
            labelled = [x for x in p.nodes if not (x.var and isinstance(scope.vars.get(x.var), Node))]
            # equal keys among the rows to create are one node
            source = Scope(missing, scope.vars)
            if not p.edges and labelled:
                values = [low.column(source, v) for _, v in labelled[0].props]
                names = [f"_p{i}" for i in range(len(values))]
                one = missing.select("*", *(v.alias(k) for v, k in zip(values, names, strict=True))).dropDuplicates(names)
                source = Scope(settled(one.drop(*names)), scope.vars)
            made = create(low, source, (p,))
            if m.on_create:
                set_items(low, made, m.on_create)
        again = low.match(Scope(outer.df, scope.vars), (p,))
        scope = Scope(again.df.drop("_row"), {**scope.vars, **{v: again.vars[v] for v in new_vars}})
    return scope


def foreach(low: Lowering, scope: Scope, f: n.Foreach) -> Scope:
    """One exploded pass: each element with each row; the rows themselves go on unchanged."""
    from meshwork.plans.lower import Scope, Value, _fresh

    df, name = low.base(scope), f"{f.var}_{next(_fresh)}"
    own = Scope(df, scope.vars)
    each = Scope(df.withColumn(name, F.explode(low.column(own, f.over))), {**scope.vars, f.var: Value(name)})
    apply(low, each, f.body)
    return Scope(df, scope.vars)


def apply(low: Lowering, scope: Scope, c: Any) -> Scope:
    if isinstance(c, n.Create):
        return create(low, scope, c.patterns)
    if isinstance(c, n.SetItems):
        return set_items(low, scope, c.items)
    if isinstance(c, n.Delete):
        return delete(low, scope, c.exprs, c.detach)
    if isinstance(c, n.Merge):
        return merge(low, scope, c)
    if isinstance(c, n.Foreach):
        return foreach(low, scope, c)
    raise CatalogError(f"{type(c).__name__} can't stand here")
