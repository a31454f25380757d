"""Benchmark decontamination: q-gram lemma filtering in overlapping diagonal bands, then banded alignment.

Texts and items are normalised (ASCII lower case; everything but ASCII letters, digits and characters beyond ASCII is a
single space). Items are cut into pieces of PIECE bytes every STRIDE bytes; shorter ones are a piece of their own. A
piece of m bytes occurs if some stretch of the text is within e = m * ERRORS // 100 edits of it. By the q-gram lemma such
a stretch shares at least m - q + 1 - q * e q-grams with the piece on diagonals at most e apart, so they fall wholly
into one of overlapping bands two strides wide. Bands with that many go to the alignment. An item of fewer than SHORT
bytes is too short for edits: it occurs where its words stand in the text one after another (Aho-Corasick, exactly).

The benchmark is the stated query set: it is broadcast in blocks of at most BLOCK bytes of items, each block against all
documents, so what is broadcast is bounded whatever the benchmark's size. Where there are several blocks, each one's
finds are written to the shared folder and its broadcast is freed before the next one is built.

Cases: null and empty texts hold nothing; items without a word are never found; repeated rows and items are reported
each; null ids come through as null; empty tables give an empty result; further columns are ignored, but for those in
`keep`, which go before the finds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import Prefix, byte_values, materialize, text_pieces

Q = 10
PIECE = 100
STRIDE = 50
#: Edits in a hundred bytes.
ERRORS = 5
#: Items of fewer normalised bytes have to occur exactly, in whole words.
SHORT = 24
BLOCK = 4 << 20
#: Bands are two of these wide; larger than any budget of edits.
BAND = 8
FINDS = "item_id long, pieces_found int, pieces int, edits int, first long, end long"
_table = np.frombuffer(bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)), np.uint8)


def normalise(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes of documents in a row, and their offsets."""
    x = _table[buf]
    space = x == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    if len(x):
        at = offsets[:-1][offsets[:-1] < len(x)]
        keep[at] = ~space[at]
    return x[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def pieces_of(item: bytes) -> list[tuple[int, bytes]]:
    """(place, piece) of a normalised item."""
    n = len(item)
    if n < SHORT:
        return []
    if n <= PIECE + STRIDE // 2:
        return [(0, item)]
    at = [*range(0, n - PIECE, STRIDE), n - PIECE]
    return [(a, item[a : a + PIECE]) for a in at]


def budget(m: int) -> int:
    return m * ERRORS // 100


def edits_within(piece: bytes, text: bytes, start: int, most: int, width: int) -> tuple[int, int] | None:
    """Fewest edits of piece against a stretch of text that begins within width of start, and the stretch's end; None if
    over most. Dynamic programming over the diagonals start - width .. start + width."""
    exact = text.find(piece, max(0, start - width), start + width + len(piece))
    if exact >= 0:
        return 0, exact + len(piece)
    p, m = np.frombuffer(piece, np.uint8), len(piece)
    low, n = start - width, 2 * width + 1
    pad = np.zeros(m + n, np.int16) - 1
    a, b = max(0, low), min(len(text), low + m + n)
    if b <= a:
        return None
    pad[a - low : b - low] = np.frombuffer(text, np.uint8)[a:b]
    steps = np.arange(n)
    cost = np.zeros(n, np.int64)
    for i in range(m):  # cost[j]: row i against the text up to low + i + j
        new = cost + (pad[i : i + n] != p[i])
        new[:-1] = np.minimum(new[:-1], cost[1:] + 1)
        new = np.minimum.accumulate(new - steps) + steps
        cost = new
        if cost.min() > most:
            return None
    j = int(cost.argmin())
    return int(cost[j]), min(len(text), low + m + j)


class Index:
    """q-grams of a block of items."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        self.item, self.pieces, self.place, self.total = [], [], [], []
        hashes, owner, at = [], [], []
        self.short: dict[bytes, list[tuple[int, int | None]]] = {}
        for k, (item_id, text) in enumerate(items):
            own = pieces_of(text)
            if text and not own:
                self.short.setdefault(text, []).append((k, item_id))
            for place, piece in own:
                h = Prefix(byte_values(np.frombuffer(piece, np.uint8))).windows(Q)
                hashes.append(h)
                owner.append(np.full(len(h), len(self.pieces)))
                at.append(np.arange(len(h)))
                self.item.append((k, item_id))
                self.pieces.append(piece)
                self.place.append(place)
                self.total.append(len(own))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.owner = np.concatenate(owner)[order] if hashes else np.zeros(0, np.int64)
        self.at = np.concatenate(at)[order] if hashes else np.zeros(0, np.int64)
        self.hash, self.begin = np.unique(h[order], return_index=True)
        self.end = np.append(self.begin[1:], len(h)).astype(np.int64) if len(h) else np.zeros(0, np.int64)
        self.bits = max(16, min(26, int(np.ceil(np.log2(64 * max(1, len(self.hash)))))))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.hash >> np.uint64(64 - self.bits)] = True
        size = np.array([len(p) for p in self.pieces], np.int64)
        self.need = np.maximum(1, size - Q + 1 - Q * (size * ERRORS // 100))

    def exact(self, text: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int | None, int, int]]:
        """(document, item, its id, start, end) of short items, each at its first place in a document."""
        if not self.short:
            return
        import ahocorasick

        words = ahocorasick.Automaton()
        for item in self.short:
            words.add_word(f" {item.decode('latin-1')} ", item)
        words.make_automaton()
        for doc, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            seen = set()
            for end, item in words.iter(f" {text[a:b].tobytes().decode('latin-1')} "):
                if item not in seen:
                    seen.add(item)
                    # the automaton's text has one space more in front
                    yield from ((doc, k, item_id, end - 1 - len(item), end - 1) for k, item_id in self.short[item])

    def candidates(self, text: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, piece, diagonal) of bands with enough shared q-grams."""
        grams = Prefix(byte_values(text)).windows(Q)
        hit = np.flatnonzero(self.seen[grams >> np.uint64(64 - self.bits)])
        if not len(hit) or not len(self.hash):
            return
        where = np.searchsorted(self.hash, grams[hit])
        where[where == len(self.hash)] = 0
        true = self.hash[where] == grams[hit]
        hit, where = hit[true], where[true]
        doc = np.searchsorted(bounds, hit, "right") - 1
        inside = hit + Q <= bounds[doc + 1]
        hit, where, doc = hit[inside], where[inside], doc[inside]
        # documents are counted whole, some 2**16 hits at a time
        at = 0
        while at < len(hit):
            upto = int(np.searchsorted(doc, doc[min(len(doc) - 1, at + (1 << 16))], "right"))
            yield from self._bands(hit[at:upto], where[at:upto], doc[at:upto], bounds)
            at = upto

    def _bands(self, hit: np.ndarray, where: np.ndarray, doc: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
        n = self.end[where] - self.begin[where]
        k = np.repeat(self.begin[where], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owner, d = self.owner[k], np.repeat(doc, n)
        diagonal = np.repeat(hit - bounds[doc], n) - self.at[k]
        band = diagonal // BAND
        key = np.stack([np.tile(d, 2), np.tile(owner, 2), np.concatenate([band, band - 1])])
        order = np.lexsort(key[::-1])
        key = key[:, order]
        new = np.ones(key.shape[1], bool)
        new[1:] = (key[:, 1:] != key[:, :-1]).any(0)
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, key.shape[1]))
        good = at[count >= self.need[key[1, at]]]
        for i in good:
            yield int(key[0, i]), int(key[1, i]), int(key[2, i] * BAND + BAND)


def find(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each document and item of which at least one piece occurs: docs' columns in keep, the item, the pieces
    found, fewest edits of one, and the stretch of the normalised text from the first to the last of them."""
    spark = docs.sparkSession
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    arrow = pa.schema([("item_id", pa.int64()), ("pieces_found", pa.int32()), ("pieces", pa.int32()), ("edits", pa.int32()), ("first", pa.int64()), ("end", pa.int64())])
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + [FINDS])

    def against(items: list[tuple[int | None, bytes]]) -> tuple[Broadcast, DataFrame]:
        held = spark.sparkContext.broadcast(Index(items))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = held.value
            for b in batches:
                at, out = [], []
                for a, _, buf, offsets in text_pieces(b.column("_text")):
                    text, bounds = normalise(buf, offsets)
                    found: dict[tuple[int, int], dict[int, tuple[int, int, int]]] = {}
                    texts: dict[int, bytes] = {}
                    for doc, piece, diagonal in index.candidates(text, bounds):
                        raw = texts.setdefault(doc, text[bounds[doc] : bounds[doc + 1]].tobytes())
                        p = index.pieces[piece]
                        e = budget(len(p))
                        got = edits_within(p, raw, diagonal, e, BAND + e)
                        if got and got[0] <= e:
                            own = found.setdefault((doc, index.item[piece][0]), {})
                            own[piece] = min(own.get(piece, (len(p), 0, 0)), (got[0], max(0, got[1] - len(p)), got[1]))
                    for (doc, _), own in found.items():
                        piece = next(iter(own))
                        at.append(a + doc)
                        out.append((index.item[piece][1], len(own), index.total[piece], min(x[0] for x in own.values()), min(x[1] for x in own.values()), max(x[2] for x in own.values())))
                    for doc, _, item_id, first, end in index.exact(text, bounds):
                        at.append(a + doc)
                        out.append((item_id, 1, 1, 0, first, end))
                if out:
                    kept = b.select(list(keep)).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True))], [*keep, *arrow.names])

        return held, rows.mapInArrow(run, schema)

    parts: list[DataFrame] = []
    items: list[tuple[int | None, bytes]] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        raw = np.frombuffer((r["text"] or "").encode("utf-8", "surrogatepass"), np.uint8)
        item = normalise(raw, np.array([0, len(raw)]))[0].tobytes().strip()
        if size and size + len(item) > block:
            held, found = against(items)
            parts.append(materialize(found, "leaks"))
            held.unpersist()
            items, size = [], 0
        items.append((r["item_id"], item))
        size += len(item)
    parts.append(against(items)[1])
    return reduce(DataFrame.unionByName, parts)


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find(docs.withColumn("doc_id", F.col("doc_id").cast("long")), benchmark)
