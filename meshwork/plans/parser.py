"""Recursive-descent parser of the query language. Keywords are case-insensitive."""

from __future__ import annotations

import re
from typing import Any

from meshwork.plans import nodes as n

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*)
    |(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')
    |(?P<number>\d+\.(?!\.)\d*(?:[eE][-+]?\d+)?|\d+[eE][-+]?\d+|\d+)
    |(?P<name>[A-Za-z_]\w*|`[^`]*`)
    |(?P<sign><=|>=|<>|\.\.|->|<<|>>|[-+*/%=<>()\[\]{},.:;|$^&\#])""",
    re.VERBOSE | re.ASCII | re.DOTALL,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_COMPARE = {"=", "<>", "<=", ">=", "<", ">"}
_STOP = {"MATCH", "OPTIONAL", "WHERE", "RETURN", "WITH", "UNWIND", "SET", "DELETE", "DETACH", "CREATE", "MERGE", "FOREACH", "ORDER", "LIMIT", "SKIP", "UNION", "ON", "USING", "CALL", "AS", "ASC", "DESC"}
TYPES = {"STRING", "INT64", "INT32", "INT16", "INT8", "UINT64", "UINT32", "UINT16", "UINT8", "INT128", "UINT128", "BOOLEAN", "BOOL", "DOUBLE", "FLOAT", "BLOB", "DATE", "TIMESTAMP", "TIMESTAMP_SEC", "TIMESTAMP_MS", "TIMESTAMP_NS", "TIMESTAMP_TZ", "INTERVAL", "SERIAL", "UUID", "JSON", "TIME"}


class ParseError(ValueError):
    """The text isn't a statement of the language."""


class Parser:
    def __init__(self, text: str):
        self.text, self.at, self.tokens = text, 0, []
        pos = 0
        while pos < len(text):
            m = _TOKEN.match(text, pos)
            if not m:
                raise ParseError(f"unexpected {text[pos]!r} at {pos}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0], m.start(), m.end()))
            pos = m.end()
        self.tokens.append(("end", "", len(text), len(text)))

    # -- tokens

    def peek(self, *words: str) -> bool:
        """Whether the next tokens are these words or signs."""
        for i, w in enumerate(words):
            kind, value, _, _ = self.tokens[min(self.at + i, len(self.tokens) - 1)]
            if kind == "string" or (value.upper() if kind == "name" else value) != w:
                return False
        return True

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise ParseError(f"expected {' '.join(words)} at {self.tokens[self.at][2]}: {self.text[self.tokens[self.at][2]:][:40]!r}")

    def name(self) -> str:
        kind, value, at, _ = self.tokens[self.at]
        if kind != "name":
            raise ParseError(f"expected a name at {at}")
        self.at += 1
        return value.strip("`")

    def string(self) -> str:
        kind, value, at, _ = self.tokens[self.at]
        if kind != "string":
            raise ParseError(f"expected a string at {at}")
        self.at += 1
        return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.DOTALL)

    def integer(self) -> int:
        minus = self.take("-")
        kind, value, at, _ = self.tokens[self.at]
        if kind != "number" or not value.isdigit():
            raise ParseError(f"expected an integer at {at}")
        self.at += 1
        return -int(value) if minus else int(value)

    def listed(self, item, end: str | None = None) -> list:
        out = [item()]
        while self.take(","):
            out.append(item())
        if end:
            self.need(end)
        return out

    # -- statements

    def statement(self) -> Any:
        explain = None
        if self.take("EXPLAIN"):
            explain = "PROFILE" if self.take("PROFILE") else "LOGICAL" if self.take("LOGICAL") else "PHYSICAL"
        elif self.take("PROFILE"):
            explain = "PROFILE"
        out = self.utility() or self.union()
        self.take(";")
        if self.tokens[self.at][0] != "end":
            raise ParseError(f"unexpected text at {self.tokens[self.at][2]}: {self.text[self.tokens[self.at][2]:][:40]!r}")
        return n.Statement("explain", {"mode": explain, "inner": out}) if explain else out

    def union(self) -> Any:
        left = self.query()
        while self.take("UNION"):
            all_ = self.take("ALL")
            left = n.Union(left, self.query(), all_)
        return left

    def options(self, equals: bool = False) -> dict[str, Any]:
        if not self.take("("):
            return {}

        def one():
            k = self.name()
            if equals or self.peek("="):
                self.need("=")
            return k.lower(), self.value()

        return dict(self.listed(one, ")"))

    def value(self) -> Any:
        if self.tokens[self.at][0] == "name":
            word = self.name()
            return {"TRUE": True, "FALSE": False}.get(word.upper(), word)
        if self.tokens[self.at][0] == "string":
            return self.string()
        return self.integer()

    def utility(self) -> n.Statement | None:
        s = n.Statement
        if self.take("CREATE", "NODE", "TABLE"):
            exists = self.take("IF", "NOT", "EXISTS")
            table, columns, key = self.name(), [], None
            self.need("(")
            while True:
                if self.take("PRIMARY", "KEY"):
                    self.need("(")
                    key = self.name()
                    self.need(")")
                else:
                    columns.append(self.column())
                if not self.take(","):
                    break
            self.need(")")
            if key is None:
                raise ParseError(f"node table {table} needs a primary key")
            return s("create_node", {"name": table, "columns": columns, "key": key, "if_not_exists": exists})
        if self.take("CREATE", "REL", "TABLE"):
            exists = self.take("IF", "NOT", "EXISTS")
            table = self.name()
            self.need("(")
            self.need("FROM")
            a = self.name()
            self.need("TO")
            b = self.name()
            columns = self.listed(self.column) if self.take(",") else []
            self.need(")")
            return s("create_rel", {"name": table, "from": a, "to": b, "columns": columns, "if_not_exists": exists})
        if self.take("DROP", "TABLE"):
            exists = self.take("IF", "EXISTS")
            return s("drop_table", {"name": self.name(), "if_exists": exists})
        if self.take("ALTER", "TABLE"):
            table = self.name()
            if self.take("ADD"):
                c, t = self.column()
                return s("alter", {"name": table, "action": "add", "column": c, "type": t})
            if self.take("DROP"):
                return s("alter", {"name": table, "action": "drop", "column": self.name()})
            self.need("RENAME")
            if self.take("TO"):
                return s("alter", {"name": table, "action": "rename_table", "to": self.name()})
            c = self.name()
            self.need("TO")
            return s("alter", {"name": table, "action": "rename", "column": c, "to": self.name()})
        for kind in ("ART", "HASH"):
            if self.take("CREATE", kind, "INDEX"):
                self.take("IF", "NOT", "EXISTS")
                index = self.name()
                self.need("FOR")
                self.need("(")
                self.name()
                self.need(":")
                table = self.name()
                self.need(")")
                self.need("ON")
                self.need("(")
                self.name()
                self.need(".")
                column = self.name()
                self.need(")")
                return s("create_index", {"kind": kind, "name": index, "table": table, "column": column})
        if self.take("DROP", "INDEX"):
            index = self.name()
            self.need("ON")
            return s("drop_index", {"name": index, "table": self.name()})
        for kind in ("FTS", "VECTOR"):
            if self.take("CREATE", kind, "INDEX"):
                exists = self.take("IF", "NOT", "EXISTS")
                index = self.name()
                self.need("ON")
                self.need("(")
                table = self.name()
                self.need(".")
                column = self.name()
                self.need(")")
                how = self.options(True) if kind == "VECTOR" and self.take("WITH") else {}
                return s("create_index", {"kind": kind, "name": index, "table": table, "column": column, "options": how, "if_not_exists": exists})
        if self.peek("CREATE", "SEQUENCE") or self.peek("CREATE", "OR", "REPLACE", "SEQUENCE"):
            self.need("CREATE")
            replace = self.take("OR", "REPLACE")
            self.need("SEQUENCE")
            exists = self.take("IF", "NOT", "EXISTS")
            args: dict[str, Any] = {"name": self.name(), "or_replace": replace, "if_not_exists": exists}
            while True:
                if self.take("START"):
                    self.take("WITH")
                    args["start"] = self.integer()
                elif self.take("INCREMENT"):
                    self.take("BY")
                    args["increment"] = self.integer()
                elif self.take("MINVALUE"):
                    args["min"] = self.integer()
                elif self.take("MAXVALUE"):
                    args["max"] = self.integer()
                elif self.take("CYCLE"):
                    args["cycle"] = True
                elif not (self.take("NO", "MINVALUE") or self.take("NO", "MAXVALUE") or self.take("NO", "CYCLE")):
                    return s("create_sequence", args)
        if self.take("DROP", "SEQUENCE"):
            exists = self.take("IF", "EXISTS")
            return s("drop_sequence", {"name": self.name(), "if_exists": exists})
        if self.take("CREATE", "MACRO"):
            macro, params = self.name(), []
            self.need("(")
            if not self.take(")"):

                def one():
                    p = self.name()
                    return p, self.expression() if self.take("=") else None

                params = self.listed(one, ")")
            self.need("AS")
            return s("create_macro", {"name": macro, "params": params, "body": self.expression()})
        if self.take("CREATE", "TYPE"):
            kind = self.name()
            self.need("AS")
            return s("create_type", {"name": kind, "type": self.type_name()})
        if self.take("COMMENT", "ON", "TABLE"):
            table = self.name()
            self.need("IS")
            return s("comment", {"name": table, "text": self.string()})
        if self.take("COPY"):
            if self.take("("):
                inner = self.union()
                self.need(")")
                self.need("TO")
                return s("copy_to", {"query": inner, "path": self.string(), "options": self.options()})
            table = self.name()
            self.need("FROM")
            return s("copy_from", {"table": table, "path": self.string(), "options": self.options()})
        for kind in ("EXPORT", "IMPORT"):
            if self.take(kind, "DATABASE"):
                return s(kind.lower(), {"path": self.string(), "options": self.options(True)})
        if self.take("ANALYZE"):
            self.take("TABLE")
            return s("analyze", {"table": None if self.take("*") else self.name()})
        for kind in ("BEGIN", "COMMIT", "ROLLBACK"):
            if self.take(kind):
                if not self.take("TRANSACTION"):
                    self.take("WORK")
                return s(kind.lower())
        if self.take("CHECKPOINT"):
            return s("checkpoint")
        if self.take("CREATE", "GRAPH"):
            graph = self.name()
            self.take("ANY")
            return s("create_graph", {"name": graph})
        for kind in ("USE", "DROP"):
            if self.take(kind, "GRAPH"):
                return s(f"{kind.lower()}_graph", {"name": self.name()})
        if self.take("ATTACH"):
            self.take("DATABASE")
            path = self.string()
            self.need("AS")
            return s("attach", {"path": path, "name": self.name(), "options": self.options(True)})
        for kind in ("DETACH", "USE"):
            if self.peek(kind) and not self.peek(kind, "DELETE"):
                self.need(kind)
                self.take("DATABASE")
                return s(kind.lower(), {"name": self.name()})
        if self.peek("LOAD") and not self.peek("LOAD", "FROM"):
            self.need("LOAD")
            self.take("EXTENSION")
            return s("load_extension", {"name": self.name()})
        for kind in ("INSTALL", "UNINSTALL"):
            if self.take(kind):
                self.take("EXTENSION")
                return s(f"{kind.lower()}_extension", {"name": self.name()})
        if self.peek("SET") and self.tokens[self.at + 2][1] == "=":
            self.need("SET")
            key = self.name()
            self.need("=")
            return s("setting", {"key": key, "value": self.value()})
        return None

    def column(self) -> tuple[str, str]:
        c, t = self.name(), self.type_name()
        if self.take("COMPRESSION"):
            self.string()
        return c, t

    def type_name(self) -> str:
        word = self.name().upper()
        if word in ("MAP", "STRUCT", "UNION"):
            self.need("(")
            if word == "MAP":
                inner = self.listed(self.type_name, ")")
            else:
                inner = [f"{c} {t}" for c, t in self.listed(self.column, ")")]
            out = f"{word}({', '.join(inner)})"
        else:
            out = word
        while self.take("["):
            if not self.peek("]"):
                self.integer()
            self.need("]")
            out += "[]"
        return out

    # -- queries

    def query(self) -> n.Query:
        clauses: list[Any] = []
        while True:
            if self.take("MATCH"):
                patterns = self.listed(self.pattern)
                fts = None
                if self.take("USING", "FTS", "INDEX"):
                    index = self.name()
                    self.need("(")
                    fts = (index, self.string())
                    self.need(")")
                clauses.append(n.Match(tuple(patterns), self.where(), False, fts))
            elif self.take("OPTIONAL", "MATCH"):
                clauses.append(n.Match(tuple(self.listed(self.pattern)), self.where(), True))
            elif self.take("UNWIND"):
                e = self.expression()
                self.need("AS")
                clauses.append(n.Unwind(e, self.name()))
            elif self.take("WITH"):
                clauses.append(self.projection(False))
            elif self.take("SET"):
                clauses.append(n.SetItems(tuple(self.listed(self.set_item))))
            elif self.take("DETACH", "DELETE"):
                clauses.append(n.Delete(tuple(self.listed(self.expression)), True))
            elif self.take("DELETE"):
                clauses.append(n.Delete(tuple(self.listed(self.expression)), False))
            elif self.take("CREATE"):
                clauses.append(n.Create(tuple(self.listed(self.pattern))))
            elif self.take("MERGE"):
                patterns, create, match = self.listed(self.pattern), (), ()
                while self.peek("ON"):
                    self.need("ON")
                    which = "create" if self.take("CREATE") else self.need("MATCH") or "match"
                    self.need("SET")
                    items = tuple(self.listed(self.set_item))
                    create, match = (items, match) if which == "create" else (create, items)
                clauses.append(n.Merge(tuple(patterns), create, match))
            elif self.take("FOREACH"):
                self.need("(")
                v = self.name()
                self.need("IN")
                over = self.expression()
                self.need("|")
                if self.take("CREATE"):
                    body: Any = n.Create((self.pattern(),))
                elif self.take("SET"):
                    body = n.SetItems(tuple(self.listed(self.set_item)))
                else:
                    detach = self.take("DETACH")
                    self.need("DELETE")
                    body = n.Delete(tuple(self.listed(self.expression)), detach)
                self.need(")")
                clauses.append(n.Foreach(v, over, body))
            elif self.take("CALL"):
                name = self.name()
                while self.take("."):
                    name += "." + self.name()
                self.need("(")
                args = [] if self.take(")") else self.listed(self.expression, ")")
                clauses.append(n.CallClause(name, tuple(args)))
            elif self.take("LOAD", "FROM"):
                path = self.string()
                clauses.append(n.Load(path, tuple(self.options().items())))
            elif self.take("RETURN"):
                clauses.append(self.projection(True))
                break
            else:
                break
        if not clauses:
            raise ParseError(f"expected a query at {self.tokens[self.at][2]}: {self.text[self.tokens[self.at][2]:][:40]!r}")
        return n.Query(tuple(clauses))

    def where(self) -> n.Expr | None:
        return self.expression() if self.take("WHERE") else None

    def set_item(self) -> tuple[n.Expr, n.Expr]:
        target = self.postfix()
        self.need("=")
        return target, self.expression()

    def projection(self, final: bool) -> n.Projection:
        distinct = self.take("DISTINCT")
        everything, items = False, []
        if self.take("*"):
            everything = True
            if self.take(","):
                items = self.listed(self.return_item)
        else:
            items = self.listed(self.return_item)
        order, limit, skip = (), None, None
        if self.take("ORDER", "BY"):

            def key():
                e = self.expression()
                return e, not self.take("DESC") and (self.take("ASC") or True)

            order = tuple(self.listed(key))
        for _ in range(2):
            if self.take("LIMIT"):
                limit = self.expression()
            elif self.take("SKIP"):
                skip = self.expression()
        return n.Projection(tuple(items), everything, distinct, order, limit, skip, None if final else self.where(), final)

    def return_item(self) -> tuple[n.Expr, str | None, str]:
        start = self.tokens[self.at][2]
        e = self.expression()
        text = self.text[start : self.tokens[self.at - 1][3]]
        return e, self.name() if self.take("AS") else None, text

    def pattern(self) -> n.Pattern:
        nodes, edges = [self.node()], []
        while self.peek("-") or self.peek("<", "-") or self.peek("->"):
            edges.append(self.edge())
            nodes.append(self.node())
        return n.Pattern(tuple(nodes), tuple(edges))

    def node(self) -> n.NodePattern:
        self.need("(")
        var = self.name() if self.tokens[self.at][0] == "name" else None
        label = self.name() if self.take(":") else None
        props = self.properties()
        self.need(")")
        return n.NodePattern(var, label, props)

    def properties(self) -> tuple[tuple[str, n.Expr], ...]:
        if not self.take("{"):
            return ()
        if self.take("}"):
            return ()

        def one():
            k = self.name()
            self.need(":")
            return k, self.expression()

        return tuple(self.listed(one, "}"))

    def edge(self) -> n.EdgePattern:
        if self.take("->"):
            return n.EdgePattern(None, None, "out")
        left = self.take("<")
        self.need("-")
        var, label, props, hops, mode = None, None, (), None, "reach"
        if self.take("["):
            var = self.name() if self.tokens[self.at][0] == "name" else None
            label = self.name() if self.take(":") else None
            if self.take("*"):
                for word in ("WALK", "TRAIL", "ACYCLIC"):
                    if self.take(word):
                        mode = word.lower()
                low, high = 1, None
                if self.tokens[self.at][0] == "number":
                    low = high = self.integer()
                    if self.take(".."):
                        high = self.integer() if self.tokens[self.at][0] == "number" else None
                elif self.take(".."):
                    high = self.integer()
                hops = (low, high)
            props = self.properties()
            self.need("]")
            if self.take("->"):
                return n.EdgePattern(var, label, "both" if left else "out", props, hops, mode)
            self.need("-")
            return n.EdgePattern(var, label, "in" if left else "both", props, hops, mode)
        if not left:
            if self.take("->"):
                return n.EdgePattern(None, None, "out")
            self.need("-")
            return n.EdgePattern(None, None, "both")
        self.take("-")
        return n.EdgePattern(None, None, "in")

    # -- expressions, loosest first

    def expression(self) -> n.Expr:
        return self.chain("OR", lambda: self.chain("XOR", lambda: self.chain("AND", self.negation)))

    def chain(self, word: str, inner) -> n.Expr:
        out = inner()
        while self.take(word):
            out = n.Op(word.lower(), (out, inner()))
        return out

    def negation(self) -> n.Expr:
        if self.take("NOT"):
            return n.Op("not", (self.negation(),))
        return self.comparison()

    def comparison(self) -> n.Expr:
        left = self.additive()
        while True:
            negate = False
            if self.peek("NOT") and not self.peek("NOT", "("):
                self.need("NOT")
                negate = True
            value = self.tokens[self.at][1]
            if self.tokens[self.at][0] == "sign" and value in _COMPARE and not negate:
                self.at += 1
                left = n.Op(value, (left, self.additive()))
                continue
            if self.take("IS"):
                no = self.take("NOT")
                self.need("NULL")
                left = n.Op("is not null" if no else "is null", (left,))
                continue
            if self.take("IN"):
                out: n.Expr = n.Op("in", (left, self.additive()))
            elif self.take("STARTS", "WITH"):
                out = n.Op("starts with", (left, self.additive()))
            elif self.take("ENDS", "WITH"):
                out = n.Op("ends with", (left, self.additive()))
            elif self.take("CONTAINS"):
                out = n.Op("contains", (left, self.additive()))
            elif self.take("LIKE"):
                out = n.Op("like", (left, self.additive()))
            elif self.take("BETWEEN"):
                low = self.additive()
                self.need("AND")
                out = n.Op("between", (left, low, self.additive()))
            else:
                if negate:
                    raise ParseError(f"misplaced NOT at {self.tokens[self.at][2]}")
                return left
            left = n.Op("not", (out,)) if negate else out

    def binary(self, signs: tuple[str, ...], inner) -> n.Expr:
        out = inner()
        while self.tokens[self.at][0] == "sign" and self.tokens[self.at][1] in signs:
            sign = self.tokens[self.at][1]
            self.at += 1
            out = n.Op(sign, (out, inner()))
        return out

    def additive(self) -> n.Expr:
        return self.binary(("|", "&", "#", "<<", ">>") if not self._in_foreach() else (), lambda: self.binary(("+", "-"), lambda: self.binary(("*", "/", "%"), lambda: self.binary(("^",), self.unary))))

    def _in_foreach(self) -> bool:
        # the bar of FOREACH ends the list expression
        depth = 0
        for kind, value, _, _ in reversed(self.tokens[: self.at]):
            if kind == "sign" and value in ")]}":
                depth += 1
            elif kind == "sign" and value in "([{":
                depth -= 1
            elif kind == "name" and value.upper() == "FOREACH" and depth == -1:
                return True
        return False

    def unary(self) -> n.Expr:
        if self.take("-"):
            inner = self.unary()
            if isinstance(inner, n.Lit) and isinstance(inner.value, (int, float)) and not isinstance(inner.value, bool):
                return n.Lit(-inner.value)
            return n.Op("neg", (inner,))
        if self.take("+"):
            return self.unary()
        return self.postfix()

    def postfix(self) -> n.Expr:
        out = self.primary()
        while True:
            if self.take("."):
                out = n.Prop(out, self.name())
            elif self.take("["):
                index = self.expression()
                self.need("]")
                out = n.Item(out, index)
            else:
                return out

    def primary(self) -> n.Expr:
        kind, value, at, _ = self.tokens[self.at]
        if kind == "string":
            return n.Lit(self.string())
        if kind == "number":
            self.at += 1
            return n.Lit(int(value) if value.isdigit() else float(value))
        if self.take("$"):
            return n.Param(self.name())
        if self.take("("):
            out = self.expression()
            self.need(")")
            return out
        if self.take("["):
            return n.ListOf(() if self.take("]") else tuple(self.listed(self.expression, "]")))
        if self.peek("{"):
            return n.MapOf(self.properties())
        if kind != "name":
            raise ParseError(f"expected an expression at {at}: {self.text[at:][:40]!r}")
        word = value.upper()
        if word in ("TRUE", "FALSE", "NULL") and not self.tokens[self.at + 1][1] == "(":
            self.at += 1
            return n.Lit({"TRUE": True, "FALSE": False, "NULL": None}[word])
        if word == "CASE":
            return self.case()
        if word == "EXISTS" and self.tokens[self.at + 1][1] == "{":
            self.at += 2
            inner = self.union()
            self.need("}")
            return n.Exists(inner)
        if word in ("ANY", "ALL", "NONE", "SINGLE") and self.tokens[self.at + 1][1] == "(" and self.tokens[self.at + 3][1].upper() == "IN":
            self.at += 2
            var = self.name()
            self.need("IN")
            of = self.expression()
            self.need("WHERE")
            where = self.expression()
            self.need(")")
            return n.Quantifier(word.lower(), var, of, where)
        if self.tokens[self.at + 1][1] == "->" and self.tokens[self.at + 1][0] == "sign":
            var = self.name()
            self.need("->")
            return n.Lambda(var, self.expression())
        if word in _STOP and value[0] != "`" and self.tokens[self.at + 1][1] != "(":
            raise ParseError(f"unexpected {value} at {at}")
        name = self.name()
        if self.take("("):
            if self.take("*"):
                self.need(")")
                return n.Call(name.lower(), (), star=True)
            distinct = self.take("DISTINCT")
            args = () if self.take(")") else tuple(self.arguments())
            return n.Call(name.lower(), args, distinct)
        return n.Var(name)

    def arguments(self) -> list[n.Expr]:
        def one():
            if self.take("AS"):  # cast(x AS TYPE)
                return n.Lit(self.type_name())
            e = self.expression()
            return e

        out = [one()]
        while self.take(",") or self.peek("AS"):
            out.append(one())
        self.need(")")
        return out

    def case(self) -> n.Expr:
        self.need("CASE")
        subject = None if self.peek("WHEN") else self.expression()
        branches = []
        while self.take("WHEN"):
            when = self.expression()
            self.need("THEN")
            branches.append((when, self.expression()))
        default = self.expression() if self.take("ELSE") else None
        self.need("END")
        return n.Case(subject, tuple(branches), default)


def parse(text: str) -> Any:
    return Parser(text).statement()
