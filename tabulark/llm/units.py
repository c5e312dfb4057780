"""Texts cut into units (a word with the blank before it, a line end) and a bounded per-process cache
of what each distinct unit encodes to, so that an encoder only ever sees new units."""

from __future__ import annotations

import numpy as np

from .shared import mix, word_hashes

PLAIN, MARKED = 0, 1  # a unit as it is; one that counts as if one more blank stood before it


def cut(data: np.ndarray, offsets: np.ndarray, prefix: bool):
    """(start, end, kind, row) of the units of every row: they cover the row in order. A unit is a run
    of blanks with the word behind it, or one line end. prefix: the first unit of a row is MARKED."""
    begin = np.zeros(len(data) + 1, bool)
    space = data == 32
    begin[:-1] = space
    begin[1:-1] &= ~space[:-1]
    line = np.flatnonzero(data == 10)
    begin[line] = begin[line + 1] = True
    first = offsets[:-1][offsets[1:] > offsets[:-1]]
    begin[first] = True
    start = np.flatnonzero(begin[:-1])
    kind = np.zeros(len(start), np.int8)
    if prefix:
        kind[np.searchsorted(start, first)] = MARKED
    return start, np.append(start[1:], len(data)), kind, np.searchsorted(offsets, start, "right") - 1


def hashes(data, start, end, kind):
    return mix(word_hashes(data, start, end) + kind.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


class Cache:
    """Distinct units to runs of ids. encode(list of (bytes, kind)) -> list of int arrays."""

    def __init__(self, encode, dtype, most: int = 1_000_000):
        self.encode, self.dtype, self.most = encode, dtype, most
        self.clear()

    def clear(self):
        self.known, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0

    def ids(self, data, start, end, kind):
        """(flat ids, number of ids of each unit)."""
        h = hashes(data, start, end, kind)
        u, first, inv = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) + len(u) > self.most:
            self.clear()
        p = np.searchsorted(self.known, u)
        seen = np.zeros(len(u), bool)
        ok = p < len(self.known)
        seen[ok] = self.known[p[ok]] == u[ok]
        new = np.flatnonzero(~seen)
        if len(new):
            raw = data.tobytes()
            runs = self.encode([(raw[start[i] : end[i]], int(kind[i])) for i in first[new]])
            n = np.array([len(r) for r in runs], np.int64)
            flat = np.concatenate(runs).astype(self.dtype) if n.sum() else np.zeros(0, self.dtype)
            while self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(flat)] = flat
            at = self.used + np.cumsum(n) - n
            self.used += len(flat)
            where = p[new]
            self.known, self.at, self.n = np.insert(self.known, where, u[new]), np.insert(self.at, where, at), np.insert(self.n, where, n)
            p = np.searchsorted(self.known, u)
        n = self.n[p][inv]
        return ragged(self.flat, self.at[p][inv], n), n


def ragged(flat, at, n):
    """The runs flat[at[i] : at[i] + n[i]] one after another."""
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    step = np.repeat(at - (ends - n), n)
    step += np.arange(total)
    return flat[step]
