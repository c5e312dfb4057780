"""Benchmark decontamination by latent semantic retrieval.

1. Documents become rows of 32-bit word hashes (runs of letters and digits, ASCII case ignored), written once;
   the passage frequency of each of 2**FEATURE_BITS hashed terms is counted over all passages.
2. A randomised SVD of the matrix of all TF-IDF passages, distributed: every task multiplies its passages
   by a random matrix and back, the products are summed, and the single-pass Nystroem form of the
   eigenproblem (Halko, Martinsson, Tropp 2011; Tropp et al. 2017) gives the right singular vectors.
3. Windows of every document, as wide as the item (in steps of STEP words, or an eighth of a long item), are
   compared with benchmark items by the cosine of the latent vectors. Step 4 needs COVER of an item's n words in the
   window, so of any n - ceil(COVER n) + RARE of them at least RARE: windows that have fewer of the item's rarest
   ones can't pass it and, with prune, aren't compared. No pair is lost by that: prune=False compares every window
   with every item and finds the same.
4. A pair above COSINE is checked word by word: the longest common subsequence of item and window must
   cover COVER of the item, and of its answer (its last ANSWER words) ANSWER_COVER.

Items of fewer than LEAST words are searched for exactly: their whole sequence of words, where each code
point of a script without blanks counts as a word. One word alone is not searched for.

Items are compared in slabs of SLAB items and SLAB_WORDS words, so what a task holds of the benchmark has a bound
at any size of it. Windows and subsequences of long items are compared few at a time.
Defined results: (doc_id, item_id, cosine, covered) with the best of each pair. Null and blank texts and
items match nothing, nor do items of one word or code point; pairs found exactly have cosine and cover 1; rows with a null doc_id or item_id are left
out. Repeated rows count once in the result, ties of cosine or cover do not matter, other columns neither.
Documents shorter than an item's window are one window. Empty tables find nothing; documents and items of any
length are searched whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ALNUM, Scratch, as_bytes, materialize, text_chunks, tidied, window_hash, windows, without, word_hashes, words, workers

FEATURE_BITS, RANK, OVERSAMPLE = 14, 26, 6
PASSAGE, STEP = 32, 8
COSINE, COVER, ANSWER, ANSWER_COVER, LEAST, RARE = 0.4, 0.6, 8, 0.5, 8, 3
SLAB, SLAB_WORDS = 20_000, 1_000_000
HELD = 8_000_000  # numbers that a comparison holds at once
CHUNK_WORDS = 250_000
GATE_BITS = 22
BLOCKS = 64  # a matrix of terms is summed in so many parts
TERMS = 1 << FEATURE_BITS


_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def _hashed(batch):
    for lo, hi, data, offsets in text_chunks(batch.column(1)):
        data = _LOW[data]
        start, end, row = words(data, offsets, ALNUM)
        h = (word_hashes(data, start, end) >> np.uint64(32)).astype(np.uint32)
        yield lo, hi, h, np.searchsorted(row, np.arange(hi - lo + 1))


def _terms(h):
    return (h & np.uint32(TERMS - 1)).astype(np.uint16)


def _passages(at):
    """Starts of the passages of every row: each begins at the row's start and every PASSAGE words."""
    n = np.diff(at)
    many = -(-n // PASSAGE)
    first = np.repeat(at[:-1], many)
    return first + PASSAGE * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))


def _tokenize(batches):
    df = np.zeros(TERMS, np.int64)
    for batch in batches:
        ids = batch.column(0)
        known = ~np.asarray(ids.is_null())
        for lo, hi, h, at in _hashed(batch):
            if len(h):
                start = _passages(at)
                f = _terms(h)
                order = np.argsort(f, kind="stable")
                f, passage = f[order], np.repeat(np.arange(len(start)), np.diff(np.append(start, len(h))))[order]
                df += np.bincount(f[np.append(True, (f[1:] != f[:-1]) | (passage[1:] != passage[:-1]))], minlength=TERMS)
            cells = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(h)])
            rows = pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), cells, pa.nulls(hi - lo, pa.int32()), pa.nulls(hi - lo, pa.binary())], names=["doc_id", "words", "block", "part"])
            keep = (np.diff(at) > 0) & known[lo:hi]
            yield rows if keep.all() else rows.filter(pa.array(keep))
    if df.any():
        parts = np.split(df, BLOCKS)
        yield pa.RecordBatch.from_arrays([pa.nulls(BLOCKS, pa.int64()), pa.nulls(BLOCKS, pa.binary()), pa.array(range(BLOCKS), pa.int32()), pa.array([as_bytes(x) for x in parts], pa.binary())], names=["doc_id", "words", "block", "part"])


def _summed(parts: DataFrame, dtype) -> np.ndarray | None:
    """Sum per block over all tasks, blocks put together: TERMS rows, whatever the data's size."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(pdf["part"].iloc[0]) // dtype().itemsize, dtype)
        for x in pdf["part"]:
            total += np.frombuffer(x, dtype)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [as_bytes(total)]})

    rows = sorted(parts.groupBy("block").applyInPandas(add, "block int, part binary").collect())
    return np.concatenate([np.frombuffer(r["part"], dtype) for r in rows]).reshape(TERMS, -1) if rows else None


def _runs(batches):
    """(doc_ids, words of all, starts) of some documents at a time."""
    for batch in batches:
        ids, cells = batch.column(0).to_numpy(), batch.column(1)
        at = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1].astype(np.int64) // 4
        every = np.frombuffer(cells.buffers()[2], np.uint32)
        lo = 0
        while lo < len(ids):
            hi = min(len(ids), max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK_WORDS, "right")) - 1))
            yield ids[lo:hi], every[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            lo = hi


def _padded(f, at, step):
    """Terms of every row filled up to whole steps with the term TERMS, which weighs nothing."""
    n = np.diff(at)
    full = -(-n // step) * step
    begin = np.cumsum(full) - full
    out = np.full(int(full.sum()), TERMS, np.int32)
    out[np.arange(len(f)) + np.repeat(begin - at[:-1], n)] = f
    return out.reshape(-1, step)


def _products(held):
    def run(batches):
        idf, omega = held.value
        weighted = np.append(idf[:, None] * omega, np.zeros((1, omega.shape[1]), np.float32), axis=0)
        square = np.append(idf**2, np.float32(0))
        total = np.zeros_like(omega)
        for _ids, h, at in _runs(batches):
            f = _terms(h)
            grid = _padded(f, at, PASSAGE)
            y = weighted[grid].sum(1)
            y /= square[grid].sum(1)[:, None] + 1e-9
            n = np.diff(at)
            many = -(-n // PASSAGE)
            passage = np.repeat(np.cumsum(many) - many, n) + (np.arange(len(f)) - np.repeat(at[:-1], n)) // PASSAGE
            order = np.argsort(f, kind="stable")
            g = f[order]
            head = np.append(0, np.flatnonzero(np.diff(g)) + 1)
            total[g[head]] += idf[g[head]][:, None] * np.add.reduceat(y[passage[order]], head, axis=0)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([as_bytes(x) for x in np.split(total, BLOCKS)], pa.binary())], names=["block", "part"])

    return run


def singular_vectors(z: np.ndarray, omega: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors of A from z = A'A omega, by the Nystroem form with a small shift."""
    z, omega = z.astype(np.float64), omega.astype(np.float64)
    shift = np.sqrt(len(z)) * np.finfo(np.float32).eps * max(np.linalg.norm(z), 1e-12)
    moved = z + shift * omega
    gram = omega.T @ moved
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    ok = value > value.max() * 1e-9
    u, _s, _ = np.linalg.svd(moved @ (vector[:, ok] / np.sqrt(value[ok])), full_matrices=False)
    return u[:, :rank].astype(np.float32)


class Index:
    """Benchmark items: latent vectors, and which of them a rare word points to."""

    def __init__(self, items, idf, vectors, cover: float):
        self.term = np.append(idf[:, None] * vectors, np.zeros((1, vectors.shape[1]), np.float32), axis=0).astype(np.float32)
        self.ids = np.array([i for i, _ in items], np.int64)
        self.n = np.array([len(w) for _, w in items], np.int64)
        self.step = np.maximum(STEP, 2 ** np.floor(np.log2(np.maximum(self.n // 8, 1))).astype(np.int64))
        self.wide = -(-self.n // self.step) + 1
        self.flat, self.at = np.concatenate([w for _, w in items]).astype(np.int64), np.cumsum(self.n) - self.n
        word, item = [], []
        for i, (_, w) in enumerate(items):
            few = len(w) - int(np.ceil(cover * len(w) - 1e-9)) + RARE
            rarest = np.argsort(-idf[_terms(w)], kind="stable")[:few]
            u = np.unique(w[rarest])
            word.append(u)
            item.append(np.full(len(u), i))
        word, item = np.concatenate(word), np.concatenate(item)
        order = np.argsort(word, kind="stable")
        self.word, self.item = word[order], item[order]
        self.gate = np.zeros(1 << GATE_BITS, bool)
        self.gate[self.word & np.uint32((1 << GATE_BITS) - 1)] = True
        v = np.array([self.term[_terms(w)].sum(0) for _, w in items], np.float32)
        self.vector = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def padded(self, i):
        """Words of the items i, filled up with -1."""
        place = np.arange(int(self.n[i].max()))
        return np.where(place < self.n[i][:, None], self.flat[np.minimum(self.at[i][:, None] + place, len(self.flat) - 1)], -1)


def common_subsequence(items: np.ndarray, windows: np.ndarray):
    """Length of the longest common subsequence of each row of items (padded with -1) and of windows
    (padded with -2)."""
    best = np.zeros((len(items), items.shape[1] + 1), np.int32)
    for k in range(windows.shape[1]):
        grown = np.maximum(best[:, 1:], best[:, :-1] + (items == windows[:, k : k + 1]))
        best[:, 1:] = np.maximum.accumulate(grown, axis=1)
    return best[:, -1].astype(np.int64)


def covers(items: np.ndarray, n: np.ndarray, windows: np.ndarray):
    """Share of each item, and of its answer, that the window has in order."""
    last = n[:, None] - ANSWER + np.arange(ANSWER)
    answer = np.where(last >= 0, np.take_along_axis(items, np.maximum(last, 0), 1), -1)
    return common_subsequence(items, windows) / n, common_subsequence(answer, windows) / np.minimum(n, ANSWER)


def _windows_of(index, h, at, prune):
    """(item, first word, row) of every window with RARE or more of an item's rarest words; without prune of all."""
    if prune:
        place = np.flatnonzero(index.gate[h & np.uint32((1 << GATE_BITS) - 1)])
        a, b = np.searchsorted(index.word, h[place], "left"), np.searchsorted(index.word, h[place], "right")
        hits = b - a
        place, item = np.repeat(place, hits), index.item[ragged_range(a, hits)]
    else:
        place, item = np.repeat(np.arange(0, len(h)), len(index.ids)), np.tile(np.arange(len(index.ids)), len(h))
    row = np.searchsorted(at, place, "right") - 1
    step = index.step[item]
    steps = -(-np.diff(at)[row] // step)
    own = (place - at[row]) // step
    # windows begin at steps own - wide + 1 .. own of the row, none after the last that fits
    last = np.minimum(own, np.maximum(steps - index.wide[item], 0))
    low = np.maximum(np.minimum(own - index.wide[item] + 1, last), 0)
    many = last - low + 1
    begin = np.repeat(at[row], many) + np.repeat(step, many) * ragged_range(low, many)
    code, n = np.unique(begin * len(index.ids) + np.repeat(item, many), return_counts=True)
    code = code[n >= RARE] if prune else code
    begin, item = code // len(index.ids), code % len(index.ids)
    return item, begin, np.searchsorted(at, begin, "right") - 1


def _lots(size, most):
    """Slices of consecutive entries of sizes `size`, ascending, whose number times the largest is at most `most`."""
    lo = 0
    while lo < len(size):
        hi = lo + 1
        while hi < len(size) and (hi + 1 - lo) * size[hi] <= most and hi - lo < 4_000:
            hi += 1
        yield slice(lo, hi)
        lo = hi


def ragged_range(start, n):
    """start[i] .. start[i] + n[i] - 1 one after another."""
    ends = np.cumsum(n)
    return np.repeat(start - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


def _search(held, cosine, cover, answer_cover, prune):
    def run(batches):
        index = held.value
        for ids, h, at in _runs(batches):
            item, begin, row = _windows_of(index, h, at, prune)
            span = index.wide[item] * index.step[item]
            order = np.argsort(span, kind="stable")
            item, begin, row, span = item[order], begin[order], row[order], span[order]
            out = []
            for lot in _lots(span, HELD // index.term.shape[1]):
                i, a, r, wide = item[lot], begin[lot], row[lot], span[lot]
                place = a[:, None] + np.arange(int(wide[-1]))
                inside = (place < at[r + 1][:, None]) & (place < (a + wide)[:, None])
                seen = h[np.minimum(place, len(h) - 1)]
                v = index.term[np.where(inside, _terms(seen), TERMS)].sum(1)
                c = (v * index.vector[i]).sum(1) / np.maximum(np.linalg.norm(v, axis=1), 1e-9)
                near = np.flatnonzero(c >= cosine)
                if not len(near):
                    continue
                i = i[near]
                whole, answer = covers(index.padded(i), index.n[i], np.where(inside[near], seen[near].astype(np.int64), -2))
                ok = (whole >= cover) & (answer >= answer_cover)
                out += zip(ids[r[near[ok]]].tolist(), index.ids[i[ok]].tolist(), c[near[ok]].astype(float).tolist(), whole[ok].tolist())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["doc_id", "item_id", "cosine", "covered"])

    return run


def _units(batch):
    """As _hashed, with 64-bit hashes, and each code point of a script without blanks (Thai to Khmer, kana, CJK) a word."""
    for lo, hi, data, offsets in text_chunks(batch.column(1)):
        data = _LOW[data]
        after = np.append(data[1:], np.uint8(0))
        wide = (data >= 0xE3) & (data <= 0xE9) | (data == 0xE0) & (after >= 0xB8) & (after <= 0xBB) | (data == 0xF0) & (after >= 0xA0) & (after <= 0xB3)
        wide |= (data == 0xE1) & ((after >= 0x80) & (after <= 0x82) | (after >= 0x9E) & (after <= 0x9F))
        own = np.flatnonzero(wide)
        stop = own + 3 + (data[own] == 0xF0)
        rest = data.copy()
        for k in range(4):
            rest[own[own + k < stop] + k] = 32
        start, end, _ = words(rest, offsets, ALNUM)
        sign = (data[own] == 0xE3) & (after[own] == 0x80)  # ideographic blank, comma, brackets
        start, end = np.append(start, own[~sign]), np.append(end, stop[~sign])
        order = np.argsort(start)
        start, end = start[order], end[order]
        yield lo, hi, word_hashes(data, start, end), np.searchsorted(start, offsets)


def _exact(held):
    """Documents that hold a short item whole: by the window of its first LEAST words, then by the others."""

    def run(batches):
        ids, items = held.value
        heads = {}
        for k, w in enumerate(items):
            heads.setdefault(min(len(w), LEAST), []).append((int(window_hash(w[:LEAST])), k))
        heads = {n: (np.array([h for h, _ in x], np.uint64), np.array([k for _, k in x])) for n, x in ((n, sorted(x)) for n, x in heads.items())}
        for batch in batches:
            known = ~np.asarray(batch.column(0).is_null())
            for lo, hi, h, at in _units(batch):
                row, out = np.repeat(np.arange(hi - lo), np.diff(at)), set()
                for n, (head, item) in heads.items():
                    g, first = windows(h, row, n)
                    a, b = np.searchsorted(head, g, "left"), np.searchsorted(head, g, "right")
                    place, k = np.repeat(first, b - a), item[ragged_range(a, b - a)]
                    if n == LEAST:
                        whole = [p + len(items[i]) <= at[row[p] + 1] and np.array_equal(h[p : p + len(items[i])], items[i]) for p, i in zip(place, k)]
                        place, k = place[np.array(whole, bool)], k[np.array(whole, bool)]
                    out.update((r, i) for r, i in np.unique(np.stack([row[place], k], 1), axis=0).tolist() if known[lo + r])
                if out:
                    doc, item = zip(*sorted(out))
                    one = pa.array(np.ones(len(doc)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([lo + r for r in doc])), pa.array(ids[list(item)]), one, one], names=["doc_id", "item_id", "cosine", "covered"])

    return run


def read_items(benchmark: DataFrame):
    """(item_id, words) of every item long enough, and of the shorter ones of two words or code points and
    more, on the driver: the benchmark, not the corpus."""
    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct().toArrow().combine_chunks()
    out, short = [], []
    for batch in rows.to_batches():
        for (lo, hi, h, at), (_, _, u, ut) in zip(_hashed(batch), _units(batch)):
            for r in range(hi - lo):
                item = batch.column(0)[lo + r].as_py()
                if at[r + 1] - at[r] >= LEAST:
                    out.append((item, h[at[r] : at[r + 1]]))
                elif ut[r + 1] - ut[r] > 1:
                    short.append((item, u[ut[r] : ut[r + 1]]))
    return tuple(sorted(x, key=lambda y: (y[0], y[1].tobytes())) for x in (out, short))


def _slabs(items):
    """Runs of items of at most SLAB and SLAB_WORDS, one item at least."""
    lo, held = 0, 0
    for k, (_, w) in enumerate(items):
        if k > lo and (k - lo >= SLAB or held + len(w) > SLAB_WORDS):
            yield items[lo:k]
            lo, held = k, 0
        held += len(w)
    if items:
        yield items[lo:]


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, cover: float = COVER, answer_cover: float = ANSWER_COVER, rank: int = RANK, prune: bool = True) -> DataFrame:
    """(doc_id, item_id, cosine, covered) of every pair found; see the module for each edge case."""
    spark = workers(docs)
    share = spark.sparkContext.broadcast
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, cosine double, covered double"
    with Scratch(spark) as scratch:
        tokens = scratch.write(base.mapInArrow(tidied(_tokenize), "doc_id long, words binary, block int, part binary"), "decontaminate-words")
        df = _summed(tokens.where("block is not null").select("block", "part"), np.int64)
        items, short = read_items(benchmark)
        found = spark.createDataFrame([], schema)
        for slab in _slabs(short):
            held = share((np.array([i for i, _ in slab], np.int64), [w for _, w in slab]))
            found = found.union(base.mapInArrow(tidied(_exact(held)), schema))
        if df is not None and items:
            df = df.ravel()
            idf = np.log((df.sum() / PASSAGE + 1) / (df + 1)).clip(0).astype(np.float32)
            only = tokens.where("block is null").select("doc_id", "words")
            omega = np.random.default_rng(23).standard_normal((TERMS, rank + OVERSAMPLE)).astype(np.float32)
            z = _summed(only.mapInArrow(tidied(_products(share((idf, omega)))), "block int, part binary"), np.float32)
            vectors = singular_vectors(z, omega, rank)
            for slab in _slabs(items):
                held = share(Index(slab, idf, vectors, cover))
                found = found.union(only.mapInArrow(tidied(_search(held, cosine, cover, answer_cover, prune)), schema))
        return materialize(found.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("covered").alias("covered")), "decontaminate-found")


def keep_clean(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the documents that hold an item; rows with a null doc_id stay."""
    return without(docs, found.select("doc_id").distinct())
