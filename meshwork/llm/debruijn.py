"""Substring dedup by De Bruijn compaction: removes every word in a run of WINDOW words that also stands elsewhere.

Token k-mers are edges from what they overlap with before to what they overlap with behind: the words that a segment of
windows covers (see meshwork.llm.winnow) where whole segments repeat, single windows where only parts of them do.
Repeated edges whose successor is the only one, and in turn follows nothing else, lie on a nonbranching path; pointer
jumping over Spark joins gives every edge its path's head and its distance from it in a number of rounds logarithmic in
the path's length. All traversals of a path go over the whole of it, so each is one long span of a document. The words
at its source coordinates are read again: only traversals whose words equal those of another one of the path, by a
128-bit digest, are removed.

Cases: null and empty texts have no words; texts shorter than WINDOW are kept whole; repetition within one document
counts; all copies go, so repeated rows of at least WINDOW words lose all words; an empty table gives an empty result;
further columns named in `keep` pass through, whatever they are called but for the names of the results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshwork.llm.common import Prefix, check_values, materialize, merge_spans, with_row_id, word_hashes
from meshwork.llm.winnow import compared, segments, spans_by_row

WINDOW = 35
GRAM = 10
_word = re.compile(rb"[^\x20\x09-\x0D]+")


def _values(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    begin, _, words = word_hashes(buf, offsets[:-1])
    return words, check_values(words), np.searchsorted(begin, offsets)


def compact(edges: DataFrame, window: int) -> DataFrame:
    """Traversals (rid, head, first, end) of nonbranching paths by edges (rid, kind, first, count, hash).

    An edge is linked to the next one only if all occurrences of either are occurrences of both in a row.
    """
    e = edges.select("rid", "kind", "first", "count", F.col("hash").alias("edge"))
    follow = W.partitionBy("rid", "kind").orderBy("first")
    e2 = e.withColumn("_n", F.lead(F.struct("first", "edge")).over(follow))
    e2 = e2.withColumn("next", F.when(F.col("_n.first") == F.col("first") + F.col("count"), F.col("_n.edge")))
    nodes = e2.groupBy("edge").agg(F.count("*").alias("n"), F.count("next").alias("nn"), F.min("next").alias("lo"), F.max("next").alias("hi"), F.max("count").alias("count"))
    nodes = materialize(nodes, "nodes")
    out = nodes.filter("nn = n and lo = hi and lo <> edge").select(F.col("edge").alias("before"), F.col("lo").alias("_e"), F.col("n").alias("_n"), F.col("count").alias("step"))
    at = nodes.join(out, (F.col("edge") == F.col("_e")) & (F.col("n") == F.col("_n")), "left").select("edge", "n", F.coalesce("before", "edge").alias("head"), F.coalesce("step", F.lit(0)).cast("long").alias("offset"), F.col("before").isNull().alias("done"))
    at = materialize(at, "paths")
    for _ in range(40):
        if at.filter("not done").isEmpty():
            break
        up = at.select(F.col("edge").alias("_e"), F.col("head").alias("_h"), F.col("offset").alias("_o"), F.col("done").alias("_d"))
        # most edges are done early; only the others look up their head's head
        moved = at.filter("not done").join(up, F.col("head") == F.col("_e")).select("edge", "n", F.col("_h").alias("head"), (F.col("offset") + F.col("_o")).alias("offset"), F.col("_d").alias("done"))
        at = materialize(at.filter("done").unionByName(moved), "paths")
    paths = at.select(F.col("edge").alias("_e"), "head", "offset")
    walk = e.join(paths, F.col("edge") == F.col("_e")).withColumn("origin", F.col("first") - F.col("offset"))
    spans = walk.groupBy("rid", "head", "origin").agg(F.min("first").alias("first"), F.max(F.col("first") + F.col("count")).alias("_end"), F.sum("count").alias("_sum"))
    broken = F.col("_end") - F.col("first") != F.col("_sum")
    spans = spans.withColumn("_ok", F.when(broken, F.raise_error(F.lit("a path's coordinates aren't contiguous"))).otherwise(F.lit(True)))
    return spans.filter("_ok").select("rid", "head", "first", (F.col("_end") + (window - 1)).alias("end"))


def window_rows(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(rid, first, hash, copies) of each window of the wanted segments; repeats within a batch count at once."""
    lists = wanted.groupBy("rid").agg(F.collect_list(F.struct("first", "count", "copies")).alias("w"))
    joined = rows.join(lists, F.col("_rid") == F.col("rid")).select("rid", F.col("text").cast("string").alias("text"), "w")
    arrow = pa.schema([("rid", pa.int64()), ("first", pa.int32()), ("hash", pa.int64()), ("copies", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: list[tuple] = []
            for rid, text, w in zip(b.column("rid").to_pylist(), b.column("text"), b.column("w"), strict=True):
                _, _, words = word_hashes(np.frombuffer(text.as_buffer(), np.uint8))
                grams = Prefix(words).windows(window).view(np.int64)
                v = w.values
                first, count = np.asarray(v.field(0), dtype=np.int64), np.asarray(v.field(1), dtype=np.int64)
                at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                parts.append((np.full(len(at), rid), at, grams[at], np.repeat(np.array(v.field(2).to_pylist(), bool), count)))
            if not parts:
                continue
            rid, at, h, copies = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            rid, at, h, copies = rid[order], at[order], h[order], copies[order]
            if len(h):
                same = h[1:] == h[:-1]
                copies[1:] |= same
                copies[:-1] |= same
            for k in range(0, len(h), 1 << 17):
                z = slice(k, k + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(x[z], t) for x, t in zip((rid, at, h, copies), arrow.types, strict=True)], schema=arrow)

    return joined.mapInArrow(run, "rid long, first int, hash long, copies boolean")


def verified(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Of traversals (rid, head, first, end) those (rid, first, end) whose words another traversal of the path has too."""
    lists = spans.groupBy("rid").agg(F.collect_list(F.struct("head", "first", "end")).alias("w"))
    joined = rows.join(lists, F.col("_rid") == F.col("rid")).select("rid", F.col("text").cast("string").alias("text"), "w")
    arrow = pa.schema([("rid", pa.int64()), ("head", pa.int64()), ("first", pa.int32()), ("end", pa.int32()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                out: list[tuple] = []
                part = b.slice(at, 1024)
                for rid, text, w in zip(part.column("rid").to_pylist(), part.column("text"), part.column("w"), strict=True):
                    words = _word.findall(text.as_buffer())
                    v = w.values
                    for head, first, end in zip(*(v.field(i).to_pylist() for i in range(3)), strict=True):
                        out.append((rid, head, first, end, hashlib.blake2b(b" ".join(words[first:end]), digest_size=16).digest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    read = materialize(joined.mapInArrow(run, "rid long, head long, first int, end int, digest binary"), "read")
    # as a rule all traversals of a path agree; only the others are counted by digest
    odd = read.groupBy("head").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.count("*").alias("n")).filter("lo <> hi or n = 1").select(F.col("head").alias("_odd"))
    odd = materialize(odd, "odd")
    sure = read.join(odd, F.col("head") == F.col("_odd"), "left_anti")
    rest = read.join(odd, F.col("head") == F.col("_odd"), "left_semi")
    twice = rest.groupBy(F.col("head").alias("_h"), F.col("digest").alias("_d")).agg(F.count("*").alias("n")).filter("n > 1")
    return sure.select("rid", "first", "end").unionByName(rest.join(twice, (F.col("head") == F.col("_h")) & (F.col("digest") == F.col("_d")), "left_semi").select("rid", "first", "end"))


def repeated_spans(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(rid, first, end) in words of what is repeated in rows (_rid, text); spans may overlap."""
    rows = rows.select("_rid", "text")
    segs = compared(segments(rows, _values, window, gram), "segments")
    # one of each kind of segment stands for its copies
    single = materialize(window_rows(rows, segs.filter("mixed and not again"), window), "windows")
    seen = single.groupBy(F.col("hash").alias("_h")).agg(F.count("*").alias("n"), F.max("copies").alias("c")).filter("n > 1 or c").select("_h")
    found = single.join(seen, F.col("hash") == F.col("_h"), "left_semi").select("rid", F.lit(1).alias("kind"), "first", F.lit(1).alias("count"), F.xxhash64("hash").alias("hash"))
    edges = segs.filter("copies").select("rid", F.lit(0).alias("kind"), "first", "count", "hash").unionByName(found)
    return verified(rows, materialize(compact(edges, window), "spans"))


def cut(raw: bytes, spans: pa.Scalar) -> tuple[int, int, bytes]:
    """(words, words removed, what remains joined by single spaces)."""
    words = _word.findall(raw)
    if not spans.is_valid:
        return len(words), 0, b" ".join(words)
    v = spans.values
    first, end = merge_spans(np.asarray(v.field(0)), np.asarray(v.field(1)))
    edges = [0, *np.stack([first, end], 1).ravel().tolist(), len(words)]
    kept = [w for j in range(0, len(edges), 2) for w in words[edges[j] : edges[j + 1]]]
    return len(words), len(words) - len(kept), b" ".join(kept)


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep: tuple[str, ...] = ("doc_id",), texts: bool = True) -> DataFrame:
    """docs' columns in keep with n_words, n_removed, kept_sha256 and, if texts, kept_text, the kept words joined by spaces."""
    rows = with_row_id(docs.select(*dict.fromkeys([*keep, "doc_id", "text"])))
    spans = spans_by_row(repeated_spans(rows, window, gram))
    joined = rows.join(spans.withColumnsRenamed({"rid": "_doc", "spans": "_spans"}), F.col("_rid") == F.col("_doc"), "left").select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("_raw"), "_spans")
    adds = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part, out = b.slice(at, 1024), []
                for raw, s in zip(part.column("_raw"), part.column("_spans"), strict=True):
                    n, removed, kept = cut(raw.as_py(), s)
                    out.append((n, removed, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if texts else None)[: len(adds)])
                cols = [pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), adds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *cols], [*keep, *(x for x, _ in adds)])

    schema = ", ".join([f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in keep] + ["n_words long, n_removed long, kept_sha256 string"] + ["kept_text string"] * texts)
    return joined.mapInArrow(run, schema)


def query(docs: DataFrame) -> DataFrame:
    return dedup(docs, texts=False)


SQL = r"""
WITH w AS (
  SELECT r, doc_id, word, row_number() OVER (PARTITION BY r ORDER BY i) AS p FROM (
    SELECT r, doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM (
      SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents))
), n AS (
  SELECT r, p, count(*) OVER (PARTITION BY r) AS total FROM w
), win AS (
  SELECT r, p, md5(string_agg(word, ' ') OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) AS h FROM w
), rep AS (
  SELECT r, p FROM (SELECT win.r, win.p, count(*) OVER (PARTITION BY h) AS c FROM win JOIN n USING (r, p) WHERE win.p + 34 <= total) WHERE c > 1
), mark AS (
  SELECT w.r, w.p, w.word, coalesce(max(rep.p) OVER (PARTITION BY w.r ORDER BY w.p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
  FROM w LEFT JOIN rep ON w.r = rep.r AND w.p = rep.p
), g AS (
  SELECT r, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '') AS kept FROM mark GROUP BY r
)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM (SELECT row_number() OVER () AS r, doc_id FROM documents) d LEFT JOIN g USING (r)
"""
