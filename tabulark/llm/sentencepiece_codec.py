"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of the pieces.

The model file's pieces and log scores are read from its protobuf; the best segmentation maximises the
sum of scores. A character that is no piece by itself may also stand alone at the smallest score less
10 and is then written as byte pieces. White space is marked with U+2581, one marker is put before
the text. Equal scores: the segmentation whose last piece is longer wins, at each end position.

Defined results: null text gives null ids; the empty text gives no ids. `exact` tells whether
decoding gives the text back byte for byte (it does unless the text has U+2581 itself). Repeated rows
and null doc_ids are encoded like any other row; other columns are left out.

The Viterbi runs on all distinct units of a batch at once, position by position: since no piece
has a marker behind another character, nor a line end, units don't depend on each other. For a model
where that fails, each text is one unit.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import units
from .shared import text_chunks, tidied, workers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
CHUNK = 1 << 20
LONG = 192  # bytes: longer units are decoded one by one
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes):
    i = 0

    def varint():
        nonlocal i
        x = s = 0
        while True:
            b = raw[i]
            i += 1
            x |= (b & 127) << s
            s += 7
            if b < 128:
                return x

    while i < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 1:
            i += 8
            yield key >> 3, raw[i - 8 : i]
        elif kind == 5:
            i += 4
            yield key >> 3, raw[i - 4 : i]
        else:
            n = varint()
            i += n
            yield key >> 3, raw[i - n : i]


def read_model(path: str):
    """[(piece, score, type)] of a .model file."""
    out = []
    for field, value in _fields(open(path, "rb").read()):
        if field == 1:
            piece = dict(_fields(value))
            out.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
    return out


def double_array(keys: list[bytes]):
    """base, check and value of a trie: from state s, byte c leads to t = base[s] + c if check[t] == s."""
    root: dict = {}
    for k, key in enumerate(keys):
        node = root
        for c in key:
            node = node.setdefault(c, {})
        node[-1] = k
    size = 1 << 12
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    taken, low, wide, todo = bytearray(size), 257, 257, [(0, root)]
    taken[0] = 1
    while todo:
        s, node = todo.pop()
        if -1 in node:
            value[s] = node[-1]
        kids = sorted(c for c in node if c >= 0)
        if not kids:
            continue
        single = len(kids) == 1
        f, tries = low if single else wide, 0
        while True:
            f = taken.find(0, f)
            if f < 0:
                f = size
            while f + 512 >= size:
                base, check, value = (np.concatenate([x, np.full(size, v, np.int32)]) for x, v in ((base, 0), (check, -1), (value, -1)))
                taken += bytearray(size)
                size *= 2
            b = f - kids[0]
            if b > 0 and (single or not any(taken[b + c] for c in kids)):
                break
            f += 1
            tries += 1
        if single:
            low = f if b + kids[0] == f else low
        elif tries > 16:
            wide = f
        base[s] = b
        for c in kids:
            taken[b + c] = 1
            check[b + c] = s
            todo.append((b + c, node[c]))
    pad = np.full(512, -1, np.int32)
    return np.concatenate([base, np.zeros(512, np.int32)]), np.concatenate([check, pad]), np.concatenate([value, pad])


class Codec:
    def __init__(self, pieces):
        self.pieces = pieces
        live = [i for i, p in enumerate(pieces) if p[2] in (NORMAL, USER)]
        self.ids = np.array(live, np.int32)
        keys = [pieces[i][0].encode() for i in live]
        self.score = np.array([pieces[i][1] for i in live], np.float64)
        self.base, self.check, self.value = double_array(keys)
        self.longest = max(map(len, keys), default=1)
        self.unknown = float(self.score.min()) - 10 if live else -10.0
        self.byte = np.zeros(256, np.int32)
        for i, (text, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte[int(text[3:5], 16)] = i
        self.has_bytes = any(p[2] == BYTE for p in pieces)
        self.unk = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.splits = not any("\n" in p or "▁" in p.lstrip("▁") for p in (pieces[i][0] for i in live))
        said = [b"" if p[2] in (CONTROL, UNKNOWN) else bytes([int(p[0][3:5], 16)]) if p[2] == BYTE else p[0].encode().replace(MARK, b" ") for p in pieces]
        said[self.unk] = " ⁇ ".encode()
        self.said = np.frombuffer(b"".join(said), np.uint8)
        self.said_n = np.array([len(x) for x in said], np.int64)
        self.said_at = np.cumsum(self.said_n) - self.said_n

    def _fallback(self, raw: bytes):
        return [self.byte[b] for b in raw] if self.has_bytes else [self.unk]

    def viterbi_one(self, raw: bytes) -> np.ndarray:
        """One unit of any length."""
        n, base, check, value = len(raw), self.base, self.check, self.value
        best, back = [-np.inf] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            if best[i] == -np.inf:
                continue
            width = min(n - i, 1 + (raw[i] >= 0xC0) + (raw[i] >= 0xE0) + (raw[i] >= 0xF0))
            s, alone = 0, False
            for j in range(i, min(n, i + self.longest)):
                t = int(base[s]) + raw[j]
                if check[t] != s:
                    break
                s, v = t, int(value[t])
                if v >= 0:
                    alone |= j + 1 - i == width
                    if (x := best[i] + self.score[v]) > best[j + 1]:
                        best[j + 1], back[j + 1] = x, (i, v)
            if not alone and (x := best[i] + self.unknown) > best[i + width]:
                best[i + width], back[i + width] = x, (i, -1)
        out, at = [], n
        while at:
            i, v = back[at]
            out += self._fallback(raw[i:at])[::-1] if v < 0 else [self.ids[v]]
            at = i
        return np.array(out[::-1], np.int32)

    def viterbi_many(self, raws: list[bytes]) -> list[np.ndarray]:
        """As viterbi_one on each, all at once."""
        out: list = [None] * len(raws)
        size = np.array([len(r) for r in raws])
        for lo, hi in ((-1, 8), (8, 14), (14, 28), (28, 64), (64, LONG)):
            group = np.flatnonzero((size > lo) & (size <= hi))
            for part in np.array_split(group, max(1, -(-len(group) * hi // 500_000))) if len(group) else []:
                self._group(raws, size, part, out)
        for i in np.flatnonzero(size > LONG):
            out[i] = self.viterbi_one(raws[i])
        return out

    def _group(self, raws, size, part, out):
        n, length = size[part], int(size[part].max())
        m = len(part)
        text = np.zeros((length + 1, m), np.int32)
        if length:
            flat = np.frombuffer(b"".join(raws[i] for i in part), np.uint8)
            col = np.repeat(np.arange(m), n)
            text[np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n), col] = flat
        best, piece, frm = np.full((length + 1, m), -np.inf), np.full((length + 1, m), -1, np.int32), np.zeros((length + 1, m), np.int32)
        best[0] = 0
        for i in range(length):
            who = np.flatnonzero((best[i] > -np.inf) & (n > i))
            if not len(who):
                continue
            here, first = best[i][who], text[i][who]
            width = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
            alone = np.zeros(len(who), bool)
            state, on = np.zeros(len(who), np.int32), np.arange(len(who))
            for j in range(i, min(length, i + self.longest)):
                nxt = self.base[state] + text[j][who[on]]
                ok = (self.check[nxt] == state) & (n[who[on]] > j)
                on, state = on[ok], nxt[ok]
                if not len(on):
                    break
                v = self.value[state]
                hit = v >= 0
                if hit.any():
                    a, v = on[hit], v[hit]
                    alone[a] |= j + 1 - i == width[a]
                    x, w = here[a] + self.score[v], who[a]
                    up = x > best[j + 1][w]
                    w = w[up]
                    best[j + 1][w], piece[j + 1][w], frm[j + 1][w] = x[up], v[up], i
            lone = np.flatnonzero(~alone)
            if len(lone):
                w, to = who[lone], np.minimum(i + width[lone], n[who[lone]])
                x = here[lone] + self.unknown
                up = x > best[to, w]
                w, to = w[up], to[up]
                best[to, w], piece[to, w], frm[to, w] = x[up], -1, i
        at, all_cols = n.copy(), np.arange(m)
        steps, odd = [], np.zeros(m, bool)
        while True:
            on = all_cols[at[all_cols] > 0]
            if not len(on):
                break
            v = piece[at[on], on]
            odd[on[v < 0]] = True
            steps.append((on, v))
            at[on] = frm[at[on], on]
            all_cols = on
        count = np.zeros(m, np.int64)
        for on, _ in steps:
            count[on] += 1
        flat, ends = np.zeros(int(count.sum()), np.int32), np.cumsum(count)
        for k, (on, v) in enumerate(steps):
            flat[ends[on] - 1 - k] = self.ids[v]
        for k, i in enumerate(part):
            out[i] = self.viterbi_one(raws[i]) if odd[k] else flat[ends[k] - count[k] : ends[k]]

    def encode_units(self, items):
        return self.viterbi_many([(MARK if kind == units.MARKED else b"") + w.replace(b" ", MARK) for w, kind in items])

    def encode(self, text: str) -> np.ndarray:
        """One text, without cutting it into units."""
        if not text:
            return np.zeros(0, np.int32)
        return self.viterbi_one(MARK + text.encode().replace(b" ", MARK))

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        return units.ragged(self.said, self.said_at[ids], self.said_n[ids])

    def decode(self, ids) -> str:
        raw = self.decode_bytes(np.asarray(ids, np.int64)).tobytes()
        return raw[raw[:1] == b" " :].decode(errors="replace")


_codecs: dict = {}


def _encode(held):
    """Batches of (doc_id, text) to batches of (doc_id, ids, n_tokens, exact)."""

    def run(batches):
        key = id(held)
        if key not in _codecs:
            _codecs.clear()
            codec = held.value
            _codecs[key] = codec, units.Cache(codec.encode_units, np.int32)
        codec, cache = _codecs[key]
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            null = np.asarray(text.is_null())
            for lo, hi, data, offsets in text_chunks(text, CHUNK):
                rows = hi - lo
                if codec.splits:
                    start, end, kind, row = units.cut(data, offsets, True)
                    flat, n = cache.ids(data, start, end, kind)
                    per = np.bincount(row, weights=n, minlength=rows).astype(np.int64)
                else:
                    raw = data.tobytes()
                    runs = [codec.viterbi_one(MARK + raw[a:b].replace(b" ", MARK)) if b > a else np.zeros(0, np.int32) for a, b in zip(offsets, offsets[1:])]
                    flat, per = np.concatenate(runs), np.array([len(r) for r in runs])
                at = np.append(0, np.cumsum(per))
                said_at = np.append(0, np.cumsum(codec.said_n[flat]))[at]
                said = codec.decode_bytes(flat)
                want = np.diff(offsets)
                got = np.diff(said_at) - (want > 0)
                exact = got == want
                if exact.all():
                    lead = said_at[:-1][want > 0]
                    same = np.delete(said, lead)
                    if not np.array_equal(same, data):
                        exact = np.array([np.array_equal(same[a:b], data[a:b]) for a, b in zip(offsets, offsets[1:])])
                else:
                    for r in np.flatnonzero(exact):
                        exact[r] = np.array_equal(said[said_at[r] + (want[r] > 0) : said_at[r + 1]], data[offsets[r] : offsets[r + 1]])
                here = null[lo:hi]
                listed = pa.ListArray.from_arrays(pa.array(at.astype(np.int32), mask=np.append(here, False)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, rows), listed, pa.array(per.astype(np.int32), mask=here), pa.array(exact, mask=here)], names=["doc_id", "ids", "n_tokens", "exact"])

    return run


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_tokens, exact) of every document; see the module for each edge case."""
    held = workers(docs).sparkContext.broadcast(Codec(read_model(model)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(_encode(held)), "doc_id long, ids array<int>, n_tokens int, exact boolean")


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of encoded documents; null ids give null text."""
    held = workers(encoded).sparkContext.broadcast(Codec(read_model(model)))

    def run(batches):
        codec = held.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else codec.decode(x) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(tidied(run), "doc_id long, text string")
