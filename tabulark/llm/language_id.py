"""Language identification by prediction with partial matching.

For each language a tree of byte contexts of up to ORDER bytes is counted from labelled text. A byte is
predicted in its longest context that was seen there; a byte new in a context costs an escape
(method C: as many escapes as the context has different bytes), and the next shorter context is asked,
without the bytes that the longer one had. Below the empty context all byte values are alike. With the
statistics frozen, an escape from a context costs the same whatever follows, so a byte's code length is the
sum of the escapes of the contexts that don't have it and its length in the first that has. The trees stay
sparse: contexts and their bytes are keys of hash tables, shared by the languages, with a value for each.
Case of ASCII letters is ignored; all other byte values are told apart. A text starts in a context of blanks.

A text is rejected ("und") if it has no bytes, or if its rate in its best language is above that language's
level: the HIGH quantile of the rates of the held-out documents labelled with it, plus a margin of their
median. The quantile counts for no more than the median plus the margin, so noise among the labels, if
less than half of them, can't lift the level further. A language of fewer than LEAST_HELD held-out
documents takes the highest level of the others, or if all are, that of all together. Ties go to the
language first in the alphabet.
Defined results: null or blank texts are rejected with null rates; null doc_ids, repeated rows and
other columns do not matter; every byte of a text counts, however long it is. An empty training sample rejects
all; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_chunks, tidied, workers

ORDER = 4
TRAIN_DOCS = 300  # labelled documents per language, chosen by hash; a quarter of them is held out
REJECT_MARGIN = 0.35  # of the held-out median rate, above the HIGH quantile of held-out rates
HIGH, LEAST_HELD = 0.9, 8
CHUNK = 1 << 18
BYTES = 230  # byte values, without capital letters


def labelled_sample(docs: DataFrame, per_language: int = TRAIN_DOCS, seed: int = 7):
    """{language: [text]}: the labelled documents of the smallest hash, per_language of each language. What
    is broadcast and collected is that sample: per_language documents of each language, whatever the table."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    rows = (
        docs.where("lang is not null and text is not null and length(trim(text)) > 0")
        .select("lang", "doc_id", F.xxhash64(F.lit(seed), "doc_id").alias("h"))
        .withColumn("r", rank).where(F.col("r") <= per_language).select("doc_id", "r", F.col("lang").alias("l"))
    )
    found = docs.select("doc_id", "lang", "text").join(F.broadcast(rows), (docs["doc_id"] == rows["doc_id"]) & (docs["lang"] == rows["l"])).select("l", "r", "text").collect()
    out: dict[str, list] = {}
    for row in sorted(found, key=lambda x: (x["l"], x["r"], x["text"])):
        out.setdefault(row["l"], []).append(row["text"])
    return out


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class _Keys:
    """Places of codes in a sorted array: a slot for each hash, and a search among those whose slot was taken."""

    def __init__(self, keys):
        self.keys = keys if len(keys) else np.zeros(1, np.uint64) - np.uint64(1)
        self.shift = np.uint64(64 - max(8, int(4 * len(self.keys)).bit_length()))
        h = self._hash(self.keys)
        self.slot = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.slot[h[::-1]] = np.arange(len(self.keys))[::-1]
        self.over = np.flatnonzero(self.slot[h] != np.arange(len(self.keys)))
        self.crowded = np.zeros(len(self.slot), bool)
        self.crowded[h[self.over]] = True

    def _hash(self, code):
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, code):
        """(place, whether it is there)."""
        h = self._hash(code)
        at = self.slot[h]
        there = self.keys[at] == code
        more = np.flatnonzero(~there & self.crowded[h])
        if len(more):
            own = self.keys[self.over]
            p = np.minimum(np.searchsorted(own, code[more]), len(own) - 1)
            ok = own[p] == code[more]
            at[more[ok]], there[more[ok]] = self.over[p[ok]], True
        return at, there


class Ppm:
    """Frozen context trees of all languages. low[byte before and byte, language] = bits, for contexts of one byte;
    for longer ones pairs of (keys of context and byte, bits) and (keys of contexts, bits of the escape)."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER, margin: float = REJECT_MARGIN):
        self.order, self.langs = order, sorted(texts)
        part = lambda k, held: [t.encode(errors="replace") for i, t in enumerate(texts[k]) if (i % 4 == 3) == held or len(texts[k]) < 4]
        codes = [self._codes(b"".join(raws := part(k, False)), np.cumsum([0, *map(len, raws)])) for k in self.langs]
        wide = max(1, len(self.langs))
        self.low, self.known, self.escapes = np.zeros((1 << 16, wide)), [], []
        for i, code in enumerate(codes):
            p = np.full((1, 256), 1.0 / BYTES)
            p[0, 65:91] = 0
            for k in (0, 1):
                count = np.bincount((code & np.uint64((1 << 8 * (k + 1)) - 1)).astype(np.int64), minlength=256 ** (k + 1)).reshape(-1, 256)
                p = self._escaped(count, np.tile(p, (len(count) // len(p), 1)))
            with np.errstate(divide="ignore"):
                self.low[:, i] = -np.log2(p).ravel()
        for k in range(2, order + 1):
            self._grow(k, [code & np.uint64((1 << 8 * (k + 1)) - 1) for code in codes])
        rates = [np.array([self.lengths(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0, i] / len(b) for b in part(k, True) if b]) for i, k in enumerate(self.langs)]
        self.reject = self._levels(rates, margin)

    def _codes(self, data, offsets):
        """Each byte with the `order` bytes before it in its row, blanks before the first."""
        data = _FOLD[np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data]
        size = np.diff(offsets)
        at = np.arange(len(data)) + np.repeat(self.order * np.arange(1, len(size) + 1), size)
        padded = np.full(len(data) + self.order * len(size), 32, np.uint64)
        padded[at] = data
        code = padded[at]
        for j in range(1, self.order + 1):
            code |= padded[at - j] << np.uint64(8 * j)
        return code

    @staticmethod
    def _escaped(count, lower):
        """Probabilities by method C, from the counts in each context and those of the next shorter one."""
        n, d = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
        seen = count > 0
        rest = np.where(seen, 0.0, lower)
        left = rest.sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            mine = np.where(left > 0, np.where(seen, count / (n + d), d / (n + d) * rest / left), count / n)
        return np.where(n > 0, mine, lower)

    def _grow(self, k, codes):
        """Contexts of k bytes: the trees of all languages by one more level."""
        keys = np.unique(np.concatenate([np.unique(c) for c in codes])) if codes else np.zeros(0, np.uint64)
        contexts = np.unique(keys >> np.uint64(8))
        of = np.searchsorted(contexts, keys >> np.uint64(8))
        bits, escapes = self._bits(k - 1, keys & np.uint64((1 << 8 * k) - 1)).astype(np.float64), np.zeros((len(contexts), self.low.shape[1]))
        for i, code in enumerate(codes):
            own, count = np.unique(code, return_counts=True)
            at = np.searchsorted(keys, own)
            n = np.bincount(of[at], weights=count, minlength=len(contexts))
            d = np.bincount(of[at], minlength=len(contexts))
            left = 1 - np.bincount(of[at], weights=2.0 ** -bits[at, i], minlength=len(contexts))
            all_seen = d >= BYTES
            with np.errstate(divide="ignore", invalid="ignore"):
                escapes[:, i] = np.where(d > 0, np.log2(n + d) - np.log2(d) + np.log2(np.maximum(left, 1e-12)), 0)
            bits[:, i] += escapes[of, i]
            bits[at, i] = np.log2(n[of[at]] + np.where(all_seen, 0, d)[of[at]]) - np.log2(count)
        self.known.append((_Keys(keys), bits.astype(np.float32)))
        self.escapes.append((_Keys(contexts), escapes.astype(np.float32)))

    def _bits(self, k, code):
        """Bits of the last byte of each code in each language, after the k bytes before it."""
        if k < 2 or not len(code):
            return self.low[(code & np.uint64(0xFFFF)).astype(np.int64)]
        (keys, bits), (contexts, escapes) = self.known[k - 2], self.escapes[k - 2]
        at, there = keys.find(code)
        out = bits[at]
        new = np.flatnonzero(~there)
        if len(new):
            rest = self._bits(k - 1, code[new] & np.uint64((1 << 8 * k) - 1))
            at, there = contexts.find(code[new] >> np.uint64(8))
            out[new] = rest + np.where(there[:, None], escapes[at], 0)
        return out

    def lengths(self, data, offsets):
        """Bits of each row in each language."""
        total = np.zeros((len(offsets) - 1, self.low.shape[1]))
        full = np.flatnonzero(np.diff(offsets) > 0)
        if len(full) and self.langs:
            bits = self._bits(self.order, self._codes(data, offsets))
            total[full] = np.add.reduceat(bits, offsets[full], axis=0, dtype=np.float64)
        return total

    @staticmethod
    def _levels(rates, margin):
        """Highest rate that is accepted in each language."""

        def level(x):
            return min(np.quantile(x, HIGH), (1 + margin) * np.median(x)) + margin * np.median(x)

        many = [level(x) for x in rates if len(x) >= LEAST_HELD]
        if not sum(map(len, rates)):
            return np.zeros(max(1, len(rates)))
        rest = max(many) if many else level(np.concatenate(rates))
        return np.array([level(x) if len(x) >= LEAST_HELD else rest for x in rates])


def _score(held):
    def run(batches):
        model = held.value
        langs = np.array([*model.langs, "und"], object)
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in text_chunks(batch.column(1), CHUNK):
                size = np.diff(offsets)
                if model.langs:
                    bits = model.lengths(data, offsets)
                    best = bits.argmin(1)
                    order = np.sort(bits, 1)
                    rate = order[:, 0] / np.maximum(size, 1)
                    gap = (order[:, 1] - order[:, 0]) / np.maximum(size, 1) if bits.shape[1] > 1 else np.zeros(len(size))
                else:
                    best, rate, gap = np.full(len(size), -1), np.full(len(size), np.inf), np.zeros(len(size))
                blank = np.array([not data[a:b].tobytes().strip() for a, b in zip(offsets, offsets[1:])], bool)
                ok = ~blank & (rate <= model.reject[best])
                hide = blank | np.isinf(rate)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(langs[np.where(ok, best, -1)], pa.string()), pa.array(rate, mask=hide), pa.array(gap, mask=hide), pa.array(ok)], names=["doc_id", "lang_found", "bits_per_byte", "margin", "accepted"])

    return run


def identify(docs: DataFrame, model: Ppm) -> DataFrame:
    """(doc_id, lang_found, bits_per_byte, margin, accepted); see the module for each edge case."""
    held = workers(docs).sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(_score(held)), "doc_id long, lang_found string, bits_per_byte double, margin double, accepted boolean")


def keep_identified(docs: DataFrame, model: Ppm) -> DataFrame:
    """The rows of docs whose text is accepted, in one pass: the text is scored where it lies."""
    held = workers(docs).sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        score = _score(held)
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], names=["doc_id", "text"])
            ok = [x.column(4) for x in score([pair])]
            if ok:
                yield batch.filter(pa.concat_arrays(ok))

    return docs.mapInArrow(tidied(run), docs.schema)
