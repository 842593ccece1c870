"""Words of many texts at once, from the bytes of an Arrow column: borders, hashes and exact equality.

A word is a run of bytes other than space and 0x09-0x0D. Texts are never split into Python strings: byte classes come
from a table, borders from neighbouring classes, hashes from prefix sums. Blocks bound the arrays, whatever a text's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes that are classified at once.
BLOCK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@cache
def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2 ** 64."""
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    up[1:], down[1:] = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the len + 1 offsets of its texts; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(block's start, block's end, first byte, byte after the last, hash) of the words that end in each block of bytes.

    The border between two texts is a border between words, whatever bytes stand there.
    """
    up, down = powers(BLOCK + 1)
    borders = np.unique(offsets)
    open_at, open_hash = -1, 0  # a word that began in an earlier block
    for a in range(0, len(data), BLOCK):
        b = min(a + BLOCK, len(data))
        gap = _SPACE[data[a:b]]
        before, after = np.empty(b - a, bool), np.empty(b - a, bool)
        before[1:], before[0] = gap[:-1], a == 0 or _SPACE[data[a - 1]]
        after[:-1], after[-1] = gap[1:], b == len(data) or _SPACE[data[b]]
        cut = borders[np.searchsorted(borders, a) : np.searchsorted(borders, b)]
        before[cut - a] = True
        cut = borders[np.searchsorted(borders, a, "right") : np.searchsorted(borders, b, "right")]
        after[cut - a - 1] = True
        first, last = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=total[1:])
        if open_at >= 0:
            scale = pow(_BASE, a - open_at, 1 << 64)
            if not len(last):
                open_hash = (open_hash + int(total[-1]) * scale) % (1 << 64)
                yield a, b, first, last, total[:0]
                continue
            ended = (open_hash + int(total[last[0] + 1]) * scale) % (1 << 64)
            n = len(last) - 1
            h = np.concatenate([np.array([ended], np.uint64), (total[last[1:] + 1] - total[first[:n]]) * down[first[:n]]])
            starts = np.concatenate([[open_at], first[:n] + a])
        else:
            n = len(last)
            h, starts = (total[last + 1] - total[first[:n]]) * down[first[:n]], first[:n] + a
        open_at = -1
        if n < len(first):
            at = first[n : n + 1]
            open_at, open_hash = int(at[0]) + a, int(((total[-1:] - total[at]) * down[at])[0])
        yield a, b, starts, last + 1 + a, mixed(h)


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether data[a : a + n] equals data[b : b + n], for many of them."""
    out = np.ones(len(a), bool)
    short = np.flatnonzero(n < 8)
    for k in range(7):
        short = short[n[short] > k]
        out[short] &= data[a[short] + k] == data[b[short] + k]
    if len(data) >= 8:
        eight = np.ndarray((len(data) - 7,), "<u8", buffer=np.ascontiguousarray(data), strides=(1,))
        left, k = np.flatnonzero((n >= 8) & (n <= 1024)), 0
        while len(left):
            at = np.minimum(8 * k, n[left] - 8)  # the last step overlaps the one before
            out[left] &= eight[a[left] + at] == eight[b[left] + at]
            k += 1
            left = left[(n[left] > 8 * k) & out[left]]
    for i in np.flatnonzero(n > 1024):
        out[i] = np.array_equal(data[a[i] : a[i] + n[i]], data[b[i] : b[i] + n[i]])
    return out


def distinct(data: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the words that differ from all others of their text: sorted by hash, then verified byte by byte."""
    if not len(doc):
        return np.zeros(0, np.int64)
    key = h ^ mixed(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    key, doc, start, n = key[order], doc[order], start[order], (end - start)[order]
    twin = np.flatnonzero(key[1:] == key[:-1])
    same = (doc[twin] == doc[twin + 1]) & (n[twin] == n[twin + 1])
    same[same] = same_bytes(data, start[twin[same]], start[twin[same] + 1], n[twin[same]])
    new = np.ones(len(doc), bool)
    new[twin + 1] = False
    for k in np.unique(key[twin[~same]]):  # different words under one hash
        lo, hi = np.searchsorted(key, k), np.searchsorted(key, k, "right")
        seen: set = set()
        for i in range(lo, hi):
            word = (int(doc[i]), data[start[i] : start[i] + n[i]].tobytes())
            new[i] = word not in seen
            seen.add(word)
    return order[new]
