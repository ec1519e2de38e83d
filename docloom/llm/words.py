"""Vectorised word and shingle hashing over the UTF-8 bytes of many texts at once.

A word is a maximal run of bytes of a class (a to z, 0 to 9 and, if asked for, ``_``) in text that Spark has already
lower-cased. A word's hash is a polynomial over its bytes modulo 2**64, got from prefix sums, then mixed; a shingle's
hash combines those of its consecutive words. Nothing loops over words or characters in Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
SEGMENT = 1 << 19  # bytes handled at a time
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if (p := _powers.get(base)) is None or len(p) < n:
        p = np.full(n, base, np.uint64)
        p[0] = 1
        p = _powers[base] = np.multiply.accumulate(p)
    return p[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_class(extra: str = "") -> np.ndarray:
    """Table of the bytes that belong to words."""
    table = np.zeros(256, bool)
    table[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz0123456789" + extra]] = True
    return table


def _segments(inside: np.ndarray) -> list[int]:
    """Cuts of a buffer into segments of about SEGMENT bytes, none of them within a word."""
    cuts, n = [0], len(inside)
    while n - cuts[-1] > SEGMENT:
        at = cuts[-1] + SEGMENT
        while at < n and inside[at]:
            at += 1
        cuts.append(at)
    return [*cuts, n] if cuts[-1] < n or n == 0 else cuts


def words(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, index of the text, start byte, end byte) of every word; bytes count from the start of the buffer. A null is an empty text."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a word ends where its text ends
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    hashes = np.empty(len(starts), np.uint64)
    cuts = _segments(inside)
    firsts = np.searchsorted(starts, cuts)
    for k in range(len(cuts) - 1):
        lo, hi, a, b = cuts[k], cuts[k + 1], firsts[k], firsts[k + 1]
        if a == b:
            continue
        n = hi - lo
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=total[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        hashes[a:b] = (total[e] - total[s]) * _power(_INVERSE, n)[s]
    return mix(hashes), np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def shingles(word: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of every run of ``n`` words within one text."""
    if len(word) < n:
        return word[:0], np.zeros(0, np.int64)
    last = len(word) - n + 1
    total = np.zeros(last, np.uint64)
    for k in range(n):
        total = total * np.uint64(0xD6E8FEB86659FD93) + word[k : k + last]
    at = np.flatnonzero(text[:last] == text[n - 1 :])
    return mix(total[at]), at


def sets(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and texts, sorted by text, then hash, each hash once for each text."""
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    if len(hashes):
        fresh = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])))
        hashes, text = hashes[fresh], text[fresh]
    return hashes, text


def slices(texts: pa.Array, size: int = 4 << 20) -> list[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes, so that a batch of long texts needs little memory."""
    if not len(texts):
        return []
    texts = texts.cast(pa.large_string())  # a cast may drop the offset of a slice
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    out, start = [], 0
    while start < len(texts):
        end = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        end = min(len(texts), max(start + 1, end))
        out.append((start, end))
        start = end
    return out
