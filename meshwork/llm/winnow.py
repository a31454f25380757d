"""Repeated windows over all documents without a row for each window.

Every window of `length` values is assigned to its minimizer (see common.window_segments), so equal windows fall to equal
anchors at equal places. A segment, a run of windows with one minimizer, is one row. Where two segments are equal, all
their windows are; where only their anchors are, single windows have to be compared, and only there. Equal segments
within an Arrow batch are settled before the shuffle, so an anchor in a third of all documents sends one row per batch
for each of its distinct surroundings. A segment's content goes by two independent hashes of 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshwork.llm.common import PIECE, materialize, mix, split_long, text_pieces, window_segments

#: at: first window << 10 | number of windows << 2 | settled << 1 | copies. settled: the segment repeats an earlier one of
#: its batch, and anchor only deals it out; copies: an equal one is in the batch.
SCHEMA = "rid long, at long, anchor long, hash long, check long"
_arrow = pa.schema([("rid", pa.int64()), ("at", pa.int64()), ("anchor", pa.int64()), ("hash", pa.int64()), ("check", pa.int64())])

#: From bytes and document offsets to values, other values for the check, and the documents' offsets in them.
Values = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def batch_segments(texts: pa.Array, rids: np.ndarray, values: Values, length: int, k: int) -> dict[str, np.ndarray]:
    parts = []
    for a, _, buf, offsets in text_pieces(texts):
        v, other, bounds = values(buf, offsets)
        pieces = split_long(bounds, length, 4 * PIECE) if len(v) > 5 * PIECE and len(bounds) == 2 else [(0, len(v))]
        for lo, hi in pieces:
            s = window_segments(v[lo:hi], bounds if len(pieces) == 1 else np.array([0, hi - lo]), length, k, other[lo:hi])
            s["first"] = s["first"] + lo
            s["rid"] = rids[s["doc"] + a]
            parts.append(s)
    return {x: np.concatenate([p[x] for p in parts]) if parts else np.zeros(0, np.int64) for x in ("rid", "first", "count", "anchor", "hash", "check")}


def settle(s: dict[str, np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """SCHEMA's columns of a batch's segments by (rid, first), those that repeat an earlier one settled, and each row's
    place in s."""
    n = len(s["rid"])
    order = np.lexsort((s["first"], s["rid"], s["check"], s["hash"], s["anchor"]))
    a, h, c = s["anchor"][order], s["hash"][order], s["check"][order]
    again = np.zeros(n, bool)
    again[1:] = (a[1:] == a[:-1]) & (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    copies = again.copy()
    copies[:-1] |= again[1:]
    rid, first, count = (s[x][order] for x in ("rid", "first", "count"))
    packed = (first << 10) | (count << 2) | (again.astype(np.int64) << 1) | copies
    a = np.where(again, mix(rid.astype(np.uint64) * np.uint64(31) + first.astype(np.uint64)).view(np.int64), a)
    back = np.lexsort((first, rid))  # neighbours in the table are alike, which compresses
    return [x[back] for x in (rid, packed, a, h, c)], order[back]


def segments(rows: DataFrame, values: Values, length: int, k: int) -> DataFrame:
    """Segments of rows (_rid, text), those that repeat an earlier one of their batch settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = batch_segments(b.column("text"), np.asarray(b.column("_rid")), values, length, k)
            columns, _ = settle(s)
            for at in range(0, len(s["rid"]), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 17)]) for x in columns], schema=_arrow)

    return rows.select("_rid", F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def compared(segs: DataFrame, name: str, length: int | None = None) -> DataFrame:
    """Segments that aren't alone, as a table: (rid, first, count, anchor, hash, again, copies, mixed).

    again: an equal segment comes earlier; copies: an equal one exists; mixed: unequal ones share the anchor. hash names
    a segment's content. With `length`, size is what the unequal segments of the anchor cover together, and bytes, if segs
    have them, stay for these. One shuffle by anchor.
    """
    settled = F.col("at").bitwiseAND(F.lit(2)) != 0
    group = W.partitionBy("anchor")
    order = group.orderBy("hash", "check", "rid", "at")
    same = lambda f: F.coalesce((f("hash").over(order) == F.col("hash")) & (f("check").over(order) == F.col("check")), F.lit(False))
    x = segs.withColumns({"_before": same(F.lag), "_behind": same(F.lead), "count": F.shiftright("at", 2).bitwiseAND(F.lit(255)).cast("int")})
    x = x.withColumn("again", settled | F.col("_before"))
    x = x.withColumn("mixed", (F.min("hash").over(group) < F.max("hash").over(group)) | (F.min("check").over(group) < F.max("check").over(group)))
    more = []
    if length is not None:
        x = x.withColumn("size", F.sum(F.when(F.col("again"), 0).otherwise(F.col("count") + (length - 1))).over(group))
        more.append("size")
    if "bytes" in segs.columns:
        more.append(F.when(~F.col("again"), F.col("bytes")).alias("bytes"))
    x = x.withColumn("copies", (F.col("at").bitwiseAND(F.lit(1)) != 0) | F.col("again") | F.col("_behind"))
    x = x.filter("again or copies or mixed").select("rid", F.shiftright("at", 10).cast("int").alias("first"), "count", "anchor", "hash", "again", "copies", "mixed", *more)
    return materialize(x, name)


def spans_by_row(spans: DataFrame) -> DataFrame:
    """(rid, spans): the half-open spans (first, end) of each document, gathered; a document's own length bounds them."""
    return spans.groupBy("rid").agg(F.collect_list(F.struct(F.col("first").cast("int").alias("first"), F.col("end").cast("int").alias("end"))).alias("spans"))
