"""Suffix-array dedup: removes every byte that a string of `LENGTH` bytes covers which also starts earlier.

Winnowing finds the segments that can hold repeats (meshwork.llm.winnow). A segment that repeats an earlier one goes as
a whole; which do is told by 128 bits of two hashes. Distinct segments with a common anchor are put together in blocks;
each block's suffixes are sorted in two stages and adjacent common prefixes of LENGTH bytes give the classes of equal
strings, of which the earliest stays. A group of over GROUP bytes is winnowed again by longer grams: its equal windows
fall to equal anchors once more, while those that differ part, until each group fits; grams of LENGTH bytes are windows.

Cases: null and empty texts have no bytes; texts shorter than LENGTH are kept whole; rows that share an id come in
order of their text; repeated rows lose all but the first; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import byte_values, check_values, materialize, merge_spans, window_segments, with_row_id
from meshwork.llm.suffixes import common_prefixes, suffix_array, words_at
from meshwork.llm.winnow import SCHEMA, compared, segments, settle, spans_by_row

LENGTH = 100
GRAM = 32
#: Bytes in a block whose suffixes are sorted together.
BLOCK = 1 << 20
#: Bytes of segments with a common anchor that stay together.
GROUP = 1 << 18


def _values(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return byte_values(buf), check_values(buf), offsets


def segment_texts(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(anchor, size, rid, first, count, bytes) of the wanted segments."""
    lists = wanted.groupBy("rid").agg(F.collect_list(F.struct("anchor", "size", "first", "count")).alias("w"))
    joined = rows.join(lists, F.col("_rid") == F.col("rid")).select("rid", F.col("text").cast("string").cast("binary").alias("text"), "w")
    arrow = pa.schema([("anchor", pa.int64()), ("size", pa.int64()), ("rid", pa.int64()), ("first", pa.int32()), ("count", pa.int32()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in arrow]
            for rid, text, w in zip(b.column("rid").to_pylist(), b.column("text"), b.column("w"), strict=True):
                view = memoryview(text.as_buffer())
                for x in w.as_py():
                    for c, v in zip(out, (x["anchor"], x["size"], rid, x["first"], x["count"], bytes(view[x["first"] : x["first"] + x["count"] + length - 1])), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, arrow.types, strict=True)], schema=arrow)

    return joined.mapInArrow(run, "anchor long, size long, rid long, first int, count int, bytes binary")


def finer(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """The windows of segments (rid, first, bytes) as segments by grams of another size, with their bytes."""
    arrow = pa.schema([("rid", pa.int64()), ("at", pa.int64()), ("anchor", pa.int64()), ("hash", pa.int64()), ("check", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rid, first = (np.asarray(b.column(x)).astype(np.int64) for x in ("rid", "first"))
            parts = b.column("bytes").to_pylist()
            raw = b"".join(parts)
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            values, other, _ = _values(np.frombuffer(raw, np.uint8), bounds)
            s = window_segments(values, bounds, length, gram, other)
            start = bounds[s["doc"]] + s["first"]
            s["rid"], s["first"] = rid[s["doc"]], first[s["doc"]] + s["first"]
            columns, place = settle(s)
            start, size = start[place].tolist(), (s["count"][place] + length - 1).tolist()
            cut = [None if at & 2 else raw[a : a + n] for at, a, n in zip(columns[1].tolist(), start, size, strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in columns), pa.array(cut, pa.binary())], schema=arrow)

    return texts.mapInArrow(run, SCHEMA + ", bytes binary")


def block_repeats(rid: np.ndarray, first: np.ndarray, count: np.ndarray, parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the segments of a block: (segment, offset) of the windows that repeat an earlier one of the block."""
    text = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    words = words_at(text)
    order = suffix_array(text, length, words)
    shared = common_prefixes(text, order, length, words) >= length
    seg = np.repeat(np.arange(len(parts)), sizes)
    offset = np.arange(len(text)) - base[seg]
    window = offset < count[seg]
    rank = np.empty(len(parts), np.int64)
    rank[np.lexsort((first, rid))] = np.arange(len(parts))
    class_ = np.cumsum(~shared)
    keep = window[order]
    at, cls = order[keep], class_[keep]
    when = rank[seg[at]] * (int(count.max()) + 1) + offset[at]
    by = np.lexsort((when, cls))
    at, cls = at[by], cls[by]
    again = np.zeros(len(at), bool)
    again[1:] = cls[1:] == cls[:-1]
    gone = at[again]
    return seg[gone], offset[gone]


def runs(rid: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (rid, at) as spans (rid, first, end) of neighbours."""
    order = np.lexsort((at, rid))
    rid, at = rid[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (rid[1:] != rid[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(at)) - 1 if len(at) else head
    return rid[head], at[head], at[last] + length


def compare_windows(texts: DataFrame, length: int, block: int) -> DataFrame:
    """(rid, first, end) to remove among segments with common anchors. Blocks hold whole groups."""
    arrow = pa.schema([("rid", pa.int64()), ("first", pa.int32()), ("end", pa.int32())])

    def finish(rows: list[tuple]) -> pa.RecordBatch:
        rid, first, count = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        seg, offset = block_repeats(rid, first, count, [r[3] for r in rows], length)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(runs(rid[seg], first[seg] + offset, length), arrow.types, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        last = None
        for b in batches:
            for anchor, *row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if anchor != last and size >= block // 2:
                    yield finish(held)
                    held, size = [], 0
                last = anchor
                held.append(row)
                size += len(row[3])
        if held:
            yield finish(held)

    columns = texts.select("anchor", "rid", "first", "count", "bytes")
    return columns.repartition("anchor").sortWithinPartitions("anchor", "rid", "first").mapInArrow(run, "rid long, first int, end int")


def removed_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(rid, first, end) of bytes to remove from rows (_rid, text); spans may overlap."""
    large = F.col("size") > group
    mixed = F.col("mixed") & ~F.col("again")
    segs = compared(segments(rows, _values, length, gram), "segments", length)
    texts = segment_texts(rows, segs.filter(mixed), length)
    split = not segs.filter(mixed & large).isEmpty()
    if split:
        texts = materialize(texts, "texts")
    spans = []
    while True:
        spans.append(segs.filter("again").select("rid", "first", (F.col("first") + F.col("count") + (length - 1)).alias("end")))
        spans.append(materialize(compare_windows(texts.filter(~large) if split else texts, length, block), "windows"))
        if not split:
            return reduce(DataFrame.unionByName, spans)
        gram = (gram + length + 1) // 2
        segs = compared(finer(texts.filter(large), length, gram), "segments", length)
        texts = segs.filter(mixed)
        split = gram < length and not texts.filter(large).isEmpty()


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """docs' doc_id with n_bytes, n_removed, n_spans, kept_sha256 and kept, the remaining bytes."""
    rows = with_row_id(docs.select("doc_id", "text"))
    spans = spans_by_row(removed_spans(rows, length, gram, block, group))
    joined = rows.join(spans, F.col("_rid") == F.col("rid"), "left").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), "spans")
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                out = []
                part = b.slice(at, 1024)
                for i, text, s in zip(part.column(0).to_pylist(), part.column(1), part.column(2), strict=True):
                    raw = text.as_py()
                    kept, removed, n = raw, 0, 0
                    if s.is_valid:
                        v = s.values
                        first, end = merge_spans(np.asarray(v.field(0)), np.asarray(v.field(1)))
                        edges = [0, *np.stack([first, end], 1).ravel().tolist(), len(raw)]
                        kept = b"".join(raw[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2))
                        removed, n = int((end - first).sum()), len(first)
                    out.append((i, len(raw), removed, n, hashlib.sha256(kept).hexdigest(), kept))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    return joined.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def query(docs: DataFrame) -> DataFrame:
    return dedup(docs).drop("kept")


SQL = """
WITH t AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text NULLS FIRST) AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), w AS (
  SELECT r, p, substr(x, 2 * p + 1, 200) AS s FROM (SELECT r, x, unnest(range(CAST(length(x) // 2 - 99 AS BIGINT))) AS p FROM t WHERE length(x) >= 200)
), gone AS (
  SELECT r, p FROM (SELECT r, p, row_number() OVER (PARTITION BY md5(s) ORDER BY r, p) AS k FROM w) WHERE k > 1
), runs AS (
  SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS g FROM (
    SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 100 THEN 0 ELSE 1 END AS new FROM gone)
), spans AS (
  SELECT r, min(p) AS a, max(p) + 100 AS b FROM runs GROUP BY r, g
), holes AS (
  SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM spans
), kept AS (
  SELECT t.r, count(*) AS n_spans, sum(b - a) AS n_removed,
         string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS k
  FROM holes JOIN t USING (r) GROUP BY t.r
)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM t LEFT JOIN kept USING (r)
"""
