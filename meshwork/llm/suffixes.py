"""Suffix arrays by two-stage sorting, vectorised."""

from __future__ import annotations

import numpy as np


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number that compares as they do; zeros follow the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + len(text)].astype(np.uint64)
    return out


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that starts a byte later; the last one isn't."""
    n = len(text)
    at = np.full(n, n - 1, np.int64)
    differs = np.flatnonzero(text[:-1] != text[1:])
    at[differs] = differs
    at = np.minimum.accumulate(at[::-1])[::-1]
    out = np.zeros(n, bool)
    inner = at < n - 1
    out[inner] = text[at[inner]] < text[at[inner] + 1]
    return out


def direct_sort(which: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes `which` by their first depth bytes, eight at a time; only ties are looked at again."""
    n = len(words)
    out = which[np.argsort(words[which], kind="stable")]
    key = words[out]
    group = np.zeros(len(out), np.int64)
    if len(out):
        group[1:] = np.cumsum(key[1:] != key[:-1])
    for at in range(8, depth, 8):
        tied = np.zeros(len(out), bool)
        tied[1:] = group[1:] == group[:-1]
        tied[:-1] |= tied[1:]
        t = np.flatnonzero(tied)
        if not len(t):
            break
        where = out[t] + at
        key = np.where(where < n, words[np.minimum(where, n - 1)], np.uint64(0))
        order = np.lexsort((key, group[t]))
        out[t], key, g = out[t][order], key[order], group[t]
        split = np.zeros(len(t), np.int64)
        split[1:] = (key[1:] != key[:-1]) & (g[1:] == g[:-1])
        # groups stay ascending: members after a split move to numbers of their own
        fresh = np.zeros(len(out), np.int64)
        fresh[t] = split
        new = np.ones(len(out), np.int64)
        new[1:] = group[1:] != group[:-1]
        group = np.cumsum(new + fresh)
    return out


def suffix_array(text: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of text in order of their first depth bytes at least (ties beyond in any order).

    Stage one sorts the suffixes that are smaller than their successors. Stage two scans the buckets of first bytes
    upwards: when a bucket's suffixes are known, each puts the suffix one byte before it, if that is the larger one,
    at the end of that suffix's bucket. Runs of one byte are filled in waves.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    words = words_at(text) if words is None else words
    small = smaller_than_next(text)
    seeds = direct_sort(np.flatnonzero(small), words, depth + 1)
    first = text[seeds]
    cut = np.searchsorted(first, np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    pending[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        waves, wave = [], np.concatenate(pending[c]) if pending[c] else np.zeros(0, np.int64)
        while len(wave):
            waves.append(wave)
            back = wave[wave > 0] - 1
            wave = back[text[back] == c]
        bucket = np.concatenate([*waves, seeds[cut[c] : cut[c + 1]]]) if waves else seeds[cut[c] : cut[c + 1]]
        if not len(bucket):
            continue
        out.append(bucket)
        back = bucket[bucket > 0] - 1
        byte = text[back]
        up = byte > c
        back, byte = back[up], byte[up]
        if not len(back):
            continue
        order = np.argsort(byte, kind="stable")
        back, byte = back[order], byte[order]
        at = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
        for a, b in zip(at, np.append(at[1:], len(byte)), strict=True):
            pending[byte[a]].append(back[a:b])
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int, words: np.ndarray | None = None) -> np.ndarray:
    """Length of the prefix that each suffix shares with the one before it in order, counted up to `most` bytes."""
    n = len(text)
    words = words_at(text) if words is None else words
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    live = np.arange(1, n)
    at = 0
    while len(live) and at < most:
        a, b = order[live] + at, order[live - 1] + at
        inside = np.maximum(a, b) < n
        x = np.where(inside, words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)], np.uint64(2**64 - 1))
        zero = x == 0
        clear = np.zeros(len(live), np.int64)
        for shift in (32, 16, 8):
            high = (x >> np.uint64(64 - shift)) == 0
            clear += np.where(high, shift // 8, 0)
            x = np.where(high, x << np.uint64(shift), x)
        clear[zero] = 8
        out[live] += np.minimum(clear, n - np.maximum(a, b)).clip(0)
        live = live[zero]
        at += 8
    return np.minimum(out, most)
