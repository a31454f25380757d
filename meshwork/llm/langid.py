"""Language identification by cross-parsing entropy.

A suffix automaton of each language's sample is walked along a text: the longest match from where the walk stands is a
phrase, then the walk begins anew. The fewer phrases, times the logarithm of the sample's length, the more the text is
like the sample; the language with the smallest figure wins. Texts are parsed whole: all pieces of PIECE characters
advance together from the automaton's start, then the state in which the piece before really ended is walked beside
that parse until both stand in the same state, and the phrases are corrected by the difference.

Transitions are a dense table for small alphabets and a hash table over state and letter otherwise, so any number of
letters and scripts takes part. The samples alone are bounded: about SAMPLE_DOCS documents of each language, chosen by a hash of their ids, SAMPLE_CHARS
characters of letters and single spaces in all, shared evenly among them. The broadcast model grows with the number of
languages (some 4 MB each), not with the documents.

Cases: null texts and texts without a letter are `und` with score 0; a letter that no sample holds is a phrase of its
own; null languages and null ids aren't learned from; without any labelled text everything is `und`; ties go to the
language that sorts first; repeated rows are alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import remainder

SAMPLE_DOCS = 96
SAMPLE_CHARS = 40_000
PIECE = 1024
#: Characters that advance together.
GROUP = 4_000_000
#: Entries for each transition that a dense table may take; beyond, transitions are hashed.
DENSE = 32
#: How sharply the difference in phrases turns into a score.
SHARPNESS = 0.1
_MUL = np.uint64(0x9E3779B97F4A7C15)


@cache
def letter_table() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def normalised(text: str) -> str:
    """Lower-cased letters, everything else as single spaces."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def sums(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many flags are set between neighbouring ends."""
    out = np.zeros(len(ends) - 1, np.int64)
    some = np.flatnonzero(ends[1:] > ends[:-1])
    if len(some):
        out[some] = np.add.reduceat(flags.view(np.uint8), ends[some], dtype=np.int64)
    return out


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions {code: state} of each state of the automaton of all substrings; 0 is the start."""
    move: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]
    last = 0
    for c in codes:
        cur = len(move)
        move.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = cur
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if longest[q] == longest[p] + 1:
                link[cur] = q
            else:
                clone = len(move)
                move.append(dict(move[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return move


class Model:
    """Automata of all languages in one table of transitions by state and letter.

    A state is held as its number times the size of the alphabet, so that a letter's code adds up to a transition's
    place. State 0 has no transitions: texts begin there, and so does what follows a letter that a language hasn't.
    """

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        self.letters = np.array(sorted({ord(c) for t in samples.values() for c in t}), np.uint32)
        self.size = len(self.letters) + 1  # code 0: a letter in no sample
        code = {int(c): i + 1 for i, c in enumerate(self.letters)}
        keys: list[int] = []
        to: list[int] = []
        starts: list[int] = []
        states = 1
        for x in self.languages:
            move = suffix_automaton([code[ord(c)] for c in samples[x]])
            starts.append(states)
            for s, d in enumerate(move):
                keys.extend((s + states) * self.size + c for c in d)
                to.extend((t + states) * self.size for t in d.values())
            states += len(move)
        self.weight = np.array([math.log2(max(2, len(samples[x]))) for x in self.languages])
        every, targets = np.array(keys, np.int64), np.array(to, np.int64)
        self.dense = states * self.size <= DENSE * max(1, len(every))
        if self.dense:
            self.to = np.zeros(states * self.size, np.int32 if states * self.size < 1 << 31 else np.int64)
            self.to[every] = targets
        else:
            self._fill(every, targets)
        # where a phrase's first letter leads
        self.first = np.zeros((len(starts), self.size), np.int64)
        for i, s in enumerate(starts):
            self.first[i] = self.step(np.full(self.size, s * self.size), np.arange(self.size), np.zeros(self.size, np.int64))[0]

    def _fill(self, keys: np.ndarray, to: np.ndarray) -> None:
        """Open addressing with linear probing, at most half full."""
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            at, one = np.unique(slot[free], return_index=True)
            own = np.flatnonzero(free)[one]
            self.keys[at], self.to[at] = keys[own], to[own]
            rest = np.ones(len(keys), bool)
            rest[own] = False
            keys, to, slot = keys[rest], to[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MUL) >> np.uint64(64 - self.bits)).view(np.int64)

    def _found(self, key: np.ndarray) -> np.ndarray:
        """Targets of transitions, 0 where there is none."""
        if self.dense:
            return self.to[key]
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.to[slot], 0)
        left = np.flatnonzero((held != key) & (held >= 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot]
            out[left] = np.where(held == key[left], self.to[slot], 0)
            more = (held != key[left]) & (held >= 0)
            left, slot = left[more], slot[more]
        return out

    def step(self, state: np.ndarray, code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, whether a phrase begins with this letter, which then leads where `first` says)."""
        to = self._found(state + code)
        begins = to == 0
        np.copyto(to, first, where=begins, casting="same_kind")
        return to, begins

    def walk(self, codes: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases begun, last state) [language, piece] of pieces that are walked from state 0."""
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        k, n = len(self.languages), len(begin)
        state, count = np.zeros((k, n), np.int64), np.zeros((k, n), np.int32)
        alive = np.searchsorted(-length, -np.arange(1, int(length.max(initial=0)) + 1), "right")
        for t, m in enumerate(alive):
            c = codes[begin[:m] + t]
            for i in range(k):
                to, begins = self.step(state[i, :m], c, self.first[i][c])
                count[i, :m] += begins
                state[i, :m] = to
        out = np.empty((k, n), np.int64), np.empty((k, n), np.int64)
        out[0][:, order], out[1][:, order] = count, state
        return out

    def corrected(self, codes: np.ndarray, begin: np.ndarray, length: np.ndarray, lang: np.ndarray, carry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(difference in phrases, whether both parses met, last state if not) of pieces that begin in the state carry."""
        n = len(begin)
        diff, met, last = np.zeros(n, np.int64), np.zeros(n, bool), carry.copy()
        live = np.arange(n)
        true, own, t = carry, np.zeros(n, np.int64), 0
        while len(live):
            c = codes[begin[live] + t]
            first = self.first[lang[live], c]
            a, x = self.step(true, c, first)
            b, y = self.step(own, c, first)
            diff[live] += x.astype(np.int64) - y
            last[live] = a
            t += 1
            same = a == b
            met[live[same]] = True
            keep = ~same & (length[live] > t)
            live, true, own = live[keep], a[keep].astype(np.int64), b[keep].astype(np.int64)
        return diff, met, last

    def phrases(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Phrases [language, text] of texts given by bounds into codes, each parsed as a whole."""
        size = np.diff(bounds)
        pieces = np.maximum(1, -(-size // PIECE))
        text = np.repeat(np.arange(len(size)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = bounds[text] + nth * PIECE
        length = np.minimum(PIECE, bounds[text + 1] - begin)
        count, plain = self.walk(codes, begin, length)
        out = np.zeros((len(self.languages), len(size)), np.int64)
        for i, own in enumerate(count):
            out[i] = np.bincount(text, own, len(size))
        last, used, base = plain.copy(), np.zeros(plain.shape, np.int64), np.zeros(plain.shape, np.int64)
        behind = np.flatnonzero(nth > 0)
        again = False
        while len(behind):
            # pieces whose predecessor ends in another state than they were last begun in
            lang, at = np.nonzero(used[:, behind] != last[:, behind - 1])
            if not len(lang):
                break
            at = behind[at]
            if again:  # parses that didn't meet: what is behind the first such piece of a text waits for it
                one = np.unique(lang * np.int64(len(size)) + text[at], return_index=True)[1]
                lang, at = lang[one], at[one]
            carry = last[lang, at - 1]
            diff, met, state = self.corrected(codes, begin[at], length[at], lang, carry)
            np.add.at(out, (lang, text[at]), diff - base[lang, at])
            base[lang, at], used[lang, at] = diff, carry
            last[lang, at] = np.where(met, plain[lang, at], state)
            again = True
        return out

    def codes_of(self, points: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_codes"):
            self._codes = np.zeros(0x110000, np.int64)
            self._codes[self.letters] = np.arange(1, self.size)
        return self._codes[points]

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "_codes"}

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        low = [(t or "").lower() for t in texts]
        points = code_points("".join(low))
        ends = np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)
        is_letter = letter_table()[points]
        some = sums(is_letter, ends) > 0
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        codes = self.codes_of(np.where(is_letter, points, np.uint32(32)))
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]  # of other characters in a row, one stays, as a space
        starts = ends[:-1][ends[:-1] < len(points)]
        keep[starts] = is_letter[starts]  # but none that belongs to the text before
        bounds = np.concatenate([[0], np.cumsum(sums(keep, ends))])
        cost = self.phrases(codes[keep], bounds) * self.weight[:, None]
        best = cost.argmin(0)
        gap = (cost - cost.min(0)) / self.weight.mean()
        share = 1 / np.exp(-SHARPNESS * gap).sum(0)
        return [self.languages[b] if s else "und" for b, s in zip(best, some, strict=True)], [float(p) if s else 0.0 for p, s in zip(share, some, strict=True)]


def shared_out(texts: list[str], chars: int) -> str:
    """Texts joined, up to chars characters, none longer than what is left shared evenly; short ones leave theirs."""
    out, left = [], chars
    for k, t in enumerate(sorted(texts, key=lambda t: (len(t), t))):
        part = t[: left // (len(texts) - k)]
        out.append(part)
        left -= len(part)
    return " ".join(x for x in out if x)


def fit(docs: DataFrame, docs_each: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Model:
    """A model of a bounded sample: about docs_each documents of each language, chars characters of them."""
    rows = docs.filter("lang is not null and doc_id is not null and text is not null").filter(remainder(F.col("doc_id"), 3) != 1)
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model({})
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, docs_each / n))])
    mark = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    # a text's share of the sample is at most chars, so no more of it comes to the driver
    picked = rows.filter(mark < F.element_at(share, F.col("lang"))).select("lang", F.left(F.col("text").cast("string"), F.lit(chars)).alias("text")).collect()
    texts: dict[str, list[str]] = {}
    for r in picked:
        texts.setdefault(r["lang"], []).append(normalised(r["text"]))
    samples = {lang: shared_out(x, chars) for lang, x in texts.items()}
    return Model({k: v for k, v in samples.items() if v})


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' columns in keep with lang_pred and score."""
    cols = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            at = 0
            sizes = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in b.column("_text")])
            while at < b.num_rows:
                upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + GROUP, "right")))
                part = b.slice(at, upto - at)
                lang, score = m.predict(part.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])
                at = upto

    return cols.mapInArrow(run, ", ".join([f"`{c}` {cols.schema[c].dataType.simpleString()}" for c in keep] + ["lang_pred string, score double"]))


def query(docs: DataFrame) -> DataFrame:
    out = identify(docs, fit(docs))
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
