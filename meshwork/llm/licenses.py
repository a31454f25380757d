"""License scan: an Aho-Corasick automaton finds notice phrases and identifier tags; expressions behind tags are parsed
by a shunting-yard parser and evaluated.

Words are maximal runs of ASCII letters and digits and of characters beyond ASCII, in lower-cased (A-Z) text; a phrase
matches where its words stand consecutively, whatever stands between them.

Cases: null and empty texts have no words, no labels and score 0; a tag whose expression can't be parsed still gives
the labels of the identifiers before the fault, and expression_ok false; repeated rows are scanned alike; further columns pass
through `scan`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notice phrases of the method's own.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache-2",
    "redistribution and use in source and binary forms": "bsd",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "all rights reserved": "reserved",
}
TAG = "spdx license identifier"
#: Labels of identifiers in expressions; any other identifier is its own label.
IDENTIFIERS = {"apache-2.0": "apache-2", "apache-2.0-only": "apache-2"}
FAMILIES = (("cc-by-nc", "cc-by-nc"), ("cc-by-sa", "cc-by-sa"), ("agpl", "agpl"), ("lgpl", "lgpl"), ("gpl", "gpl"), ("mpl", "mpl"), ("bsd", "bsd"))
PERMISSIVE = frozenset({"mit", "apache-2", "bsd", "isc", "zlib", "unlicense", "cc0-1.0", "cc-by-4.0", "0bsd"})
_table = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_token = re.compile(r"\s*(\(|\)|[A-Za-z0-9.+:-]+)")
_rank = {"or": 1, "and": 2, "with": 3}


def label_of(identifier: str) -> str:
    x = identifier.lower().rstrip("+")
    return IDENTIFIERS.get(x) or next((label for start, label in FAMILIES if x.startswith(start)), x)


def parse(text: str) -> tuple[list[str], bool]:
    """Reverse Polish form of the longest licence expression at the start of text, and whether it is well formed.

    Shunting-yard: `with` binds tightest, then `and`, then `or`; all are left-associative.
    """
    out: list[str] = []
    stack: list[str] = []
    operand, at, ok, depth = True, 0, True, 0
    while m := _token.match(text, at):
        t = m[1]
        word = t.lower()
        if t == "(":
            if not operand:
                break
            stack.append(t)
            depth += 1
        elif t == ")":
            if operand or not depth:
                ok = ok and not (operand and depth)
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif word in _rank:
            if operand:
                ok = False
                break
            while stack and stack[-1] != "(" and _rank[stack[-1]] >= _rank[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
            at = m.end()
            continue
        elif operand:
            out.append(t.rstrip(".:-") or t)
            operand = False
        else:
            break
        at = m.end()
    if operand or depth:
        ok = False
        while stack and operand and stack[-1] != "(":  # an operator without its right side
            stack.pop()
            operand = False
    while stack:
        if (x := stack.pop()) != "(":
            out.append(x)
    return out, ok and bool(out)


def evaluate(rpn: list[str], allowed: frozenset[str] = PERMISSIVE) -> bool:
    """Whether the expression can be satisfied with allowed licences: or needs one side, and both, with its licence."""
    stack: list[bool] = []
    for t in rpn:
        if t in _rank:
            if len(stack) < 2:
                continue
            b, a = stack.pop(), stack.pop()
            stack.append(a or b if t == "or" else a and b if t == "and" else a)
        else:
            stack.append(label_of(t) in allowed)
    return bool(stack) and all(stack)


def operands(rpn: list[str]) -> list[str]:
    """Licence identifiers in the expression; what follows `with` is an exception, not a licence."""
    stack: list[list[str]] = []
    for t in rpn:
        if t in _rank:
            if len(stack) < 2:
                continue
            b, a = stack.pop(), stack.pop()
            stack.append(a if t == "with" else a + b)
        else:
            stack.append([t])
    return [x for part in stack for x in part]


def automaton() -> ahocorasick.Automaton:
    """Phrases between spaces, over text whose words are joined by single spaces; characters are bytes."""
    a = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan_text(text: str | None, a: ahocorasick.Automaton) -> dict:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(_table).split()
    joined = b" " + b" ".join(words) + b" "
    n_base, first, last, base, more, notices, tags = 0, None, None, set(), set(), 0, []
    at = seen = 0
    for end, phrase in a.iter(joined.decode("latin-1")):
        start = end - len(phrase) - 1
        if phrase in BASE:
            # starts of matches aren't in order: count spaces from the last place either way
            seen += joined.count(b" ", at, start) if start >= at else -joined.count(b" ", start, at)
            at = start
            n_base += 1
            first, last = min(seen, seen if first is None else first), max(seen, -1 if last is None else last)
            base.add(BASE[phrase])
        elif phrase == TAG:
            tags.append(phrase)
        else:
            notices += 1
            more.add(NOTICES[phrase])
    expressions, ok, free = [], True, None
    if tags:
        for m in re.finditer(r"spdx[^0-9a-z\x80-\U0010ffff]+license[^0-9a-z\x80-\U0010ffff]+identifier\s*:?[ \t]*([^\r\n]*)", text or "", re.IGNORECASE | re.ASCII):
            rpn, good = parse(m[1])
            ok = ok and good
            if rpn:
                expressions.append(" ".join(rpn))
                more.update(map(label_of, operands(rpn)))
                free = evaluate(rpn) if free is None else free and evaluate(rpn)
    labels = base | more
    evidence = n_base + notices + 2 * len(expressions)
    return {"n_words": len(words), "n_base": n_base, "first_word": first, "last_word": last, "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": 1 - 0.5**evidence, "expressions": expressions, "expression_ok": ok, "permissive": free if free is not None else (bool(labels) and labels <= PERMISSIVE)}


ARROW = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string())), ("expression_ok", pa.bool_()), ("permissive", pa.bool_())])
ADDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, expression_ok boolean, permissive boolean"


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep with what the scan finds in the text column."""
    kept = df.select(*keep, df[text].cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for b in batches:
            found = pa.RecordBatch.from_pylist([scan_text(x.as_py(), a) for x in b.column("_text")], ARROW)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *found.columns], [*keep, *ARROW.names])

    return kept.mapInArrow(run, ", ".join([f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep] + [ADDS]))


def query(docs: DataFrame) -> DataFrame:
    return scan(docs)
