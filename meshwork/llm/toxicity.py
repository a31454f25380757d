"""Toxicity as maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

Every word of a text scores its log-odds between toxic and other texts, either way, less DRIFT. The odds of a word come
from the labelled texts that hold it under a Dirichlet prior, whose mean is the rate of its stem (the first STEM bytes),
itself drawn towards the rate of all texts; a word that no labelled text holds has its stem's odds. All maximal scoring
segments of a text are found in linear time; a segment of score S in n words is as likely by chance as the
Karlin-Altschul law says, K * n * exp(-lambda * S) of them being expected, with lambda and K taken from what clean texts
score. The surprise over all significant segments goes through a logistic curve fitted on the labelled rows.

The model is fitted on at most about TRAIN_ROWS labelled rows, chosen by a hash of their ids and written once to the
shared folder; it holds all words of these. Nothing but the text is used to score.

Cases: null and empty texts have no segments and get the curve's lowest score; null labels and null ids aren't learned
from; of repeated labels of an id the larger holds; without labels of both kinds every score is the share of toxic
labels (0 if there are none); repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import collect_garbage, materialize, remainder

TRAIN_ROWS = 20_000
STEM = 4
#: Texts that the priors of a word and of a stem count for.
WORD_PRIOR = 3.0
STEM_PRIOR = 10.0
#: What each word costs a segment.
DRIFT = 0.8
#: Segments of clean texts from this score on are counted for K.
COUNTED = 3.0
THRESHOLD = 0.3
_table = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_table).split()


@dataclass
class Model:
    words: dict[bytes, float] = field(default_factory=dict)
    stems: dict[bytes, float] = field(default_factory=dict)
    rate: float = 1.0
    scale: float = 1.0
    intercept: float = -math.inf
    slope: float = 0.0

    def scores(self, words: list[bytes]) -> list[float]:
        """Log-odds of each word, less DRIFT."""
        own, stems = self.words.get, self.stems.get
        return [s if (s := own(w)) is not None else stems(w[:STEM], -DRIFT) for w in words]

    def segments(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        return maximal_segments(self.scores(words))

    def surprise(self, words: list[bytes]) -> tuple[float, list[tuple[int, int, float, float]]]:
        """log(1 + sum of -ln E) over significant segments (E < 1), and those as (first, end, score, ln E)."""
        n, found = len(words), []
        for a, b, s in self.segments(words):
            e = math.log(max(1e-300, self.scale * n)) - self.rate * s
            if e < 0:
                found.append((a, b, s, e))
        return math.log1p(-sum(x[3] for x in found)), found

    def probability(self, x: float) -> float:
        z = self.intercept + self.slope * x
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) of a sequence: the linear-time scan of Ruzzo and Tompa."""
    stack: list[list] = []  # [first, end, left total, right total, index of the nearest entry below with less on its left]
    total = 0.0
    for i, s in enumerate(scores):
        left = total
        total += s
        if s <= 0:
            continue
        entry = [i, i + 1, left, total, -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= entry[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= entry[3]:
                entry[4] = j
                stack.append(entry)
                break
            entry[0], entry[2] = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, r - left) for a, b, left, r, _ in stack]


def log_odds(toxic: dict[bytes, int], other: dict[bytes, int], texts: tuple[int, int]) -> tuple[dict[bytes, float], dict[bytes, float]]:
    """Scores of words and of stems: log-odds against those of all texts (toxic, other), less DRIFT.

    The prior of a word is WORD_PRIOR texts at the rate of its stem, that of a stem STEM_PRIOR texts at the rate of all.
    Keys of stems begin with `^`, which no word holds.
    """
    rate = texts[0] / sum(texts)
    base = math.log(rate / (1 - rate)) + DRIFT
    share = {}
    for k in chain(toxic, other.keys() - toxic.keys()):
        if k[:1] == b"^":
            t, o = toxic.get(k, 0), other.get(k, 0)
            share[k[1:]] = (t + STEM_PRIOR * rate) / (t + o + STEM_PRIOR)
    words = {}
    for k in chain(toxic, other.keys() - toxic.keys()):
        if k[:1] != b"^":
            p = share[k[:STEM]]
            words[k] = math.log((toxic.get(k, 0) + WORD_PRIOR * p) / (other.get(k, 0) + WORD_PRIOR * (1 - p))) - base
    return words, {k: math.log(p / (1 - p)) - base for k, p in share.items()}


def karlin_altschul(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum p exp(rate * s) = 1 for background shares p of scores; their mean has to be negative."""
    f = lambda r: float((share * np.expm1(r * scores)).sum())
    low, high = 1e-6, 1e-3
    if f(low) >= 0 or scores.max(initial=-1.0) <= 0:
        return low if f(low) >= 0 else 64.0
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return low


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Intercept and slope of a logistic curve by Newton's method; the ridge keeps separable data finite."""
    b = np.zeros(2)
    z = np.stack([np.ones(len(x)), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (y - p) - ridge * b
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(max(b[1], 0.0))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of about `most` labelled rows at most whose crc32 remainder isn't 2."""
    known = labels.filter("toxic is not null and doc_id is not null").filter(remainder(F.col("doc_id"), 4) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    share = int(1_000_000 * min(1.0, most / max(1, n)))
    known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < share)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").select("text", F.col("toxic").cast("long").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    sample = materialize(training_rows(docs, labels, most), "toxicity-sample")
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                own = set(words_of(text.as_py()))
                seen[toxic > 0].update(own)
                seen[toxic > 0].update({b"^" + w[:STEM] for w in own})
                seen[toxic > 0][b" texts"] += 1
        keys = list(seen[0].keys() | seen[1].keys())
        for at in range(0, len(keys), 1 << 16):
            part = keys[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([seen[1][k] for k in part], pa.int64()), pa.array([seen[0][k] for k in part], pa.int64())], ["token", "toxic", "other"])

    # bounded by TRAIN_ROWS: the words of that many texts
    counts = sample.mapInArrow(count, "token binary, toxic long, other long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).toArrow()
    keys = counts.column("token").to_pylist()
    toxic, other = dict(zip(keys, counts.column("toxic").to_pylist(), strict=True)), dict(zip(keys, counts.column("other").to_pylist(), strict=True))
    texts = toxic.pop(b" texts", 0), other.pop(b" texts", 0)
    if not all(texts):
        return Model(intercept=-math.inf if not texts[0] else math.inf)
    model = Model(*log_odds(toxic, other, texts))
    del counts, keys, toxic, other
    collect_garbage(spark)
    held = spark.sparkContext.broadcast(model)

    def background(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(kind, hundredths, n): how often words (0) and maximal segments (1) score so much."""
        seen: Counter = Counter()
        m = held.value
        for b in batches:
            for text in b.column(0):
                v = m.scores(words_of(text.as_py()))
                seen.update((0, round(100 * x)) for x in v)
                seen.update((1, round(100 * q[2])) for q in maximal_segments(v))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([k[0] for k in seen], [k[1] for k in seen], list(seen.values()))], ["kind", "s", "n"])

    rows = sorted(tuple(r) for r in sample.filter("toxic = 0").mapInArrow(background, "kind long, s long, n long").groupBy("kind", "s").agg(F.sum("n").alias("n")).collect())
    value, n = np.array([r[1] / 100 for r in rows if not r[0]]), np.array([r[2] for r in rows if not r[0]], float)
    high = sum(r[2] for r in rows if r[0] and r[1] / 100 >= COUNTED)
    if len(n):
        model.rate = karlin_altschul(value, n / n.sum())
    # expected number of clean segments that score COUNTED or more: K * n * exp(-rate * COUNTED)
    model.scale = (high + 0.5) * math.exp(model.rate * COUNTED) / max(1, n.sum())
    held.unpersist()
    held = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([m.surprise(words_of(t.as_py()))[0] for t in b.column(0)], pa.float64()), b.column(1)], ["x", "y"])

    # bounded by TRAIN_ROWS: a pair of numbers for each training row, equal ones together
    pairs = sample.mapInArrow(measure, "x double, y long").groupBy(F.round("x", 2).alias("x"), (F.col("y") > 0).cast("double").alias("y")).count().collect()
    held.unpersist()
    x = np.repeat([p["x"] for p in pairs], [p["count"] for p in pairs])
    y = np.repeat([p["y"] for p in pairs], [p["count"] for p in pairs])
    order = np.lexsort((y, x))
    model.intercept, model.slope = logistic(x[order], y[order])
    return model


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), passages: bool = False) -> DataFrame:
    """docs' columns in keep with score and predicted and, if passages, the significant toxic passages (in words)."""
    cols = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("log_e", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            p, found = [], []
            for t in b.column("_text"):
                x, segments = m.surprise(words_of(t.as_py()))
                p.append(m.probability(x))
                if passages:
                    found.append([dict(zip(("first", "end", "score", "log_e"), s, strict=True)) for s in segments])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(p, pa.float64()), pa.array([int(v >= THRESHOLD) for v in p], pa.int32()), *([pa.array(found, kind)] if passages else [])], [*keep, "score", "predicted", *["passages"] * passages])

    schema = ", ".join([f"`{c}` {cols.schema[c].dataType.simpleString()}" for c in keep] + ["score double, predicted int"] + ["passages array<struct<first:int,end:int,score:double,log_e:double>>"] * passages)
    return cols.mapInArrow(run, schema)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
