"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of BLOCK words; they are the index. Every
rolling window of BLOCK words of every document probes it. A repeat of 2 * BLOCK words or more holds a
whole block of each of its places, so all its places are hit. Hits are then extended: of every stretch of
2 * BLOCK words around a hit it is found out whether it stands anywhere else, and runs of such
stretches are joined to maximal ones. The result is exact up to 64-bit hashes.

Windows travel in binary pieces, one per task's batch and hash range, as 40 bits of hash and gaps between
places; places are turned back into documents by a table of each batch. The number of hash ranges
follows the bytes of the table, so a range stays of one size.

Defined results: (doc_id, start_word, n_words), one row for each maximal stretch of words all of which
lie in a run of MIN_WORDS words that stands in two places or more, in two documents or in one. Words are runs
without ASCII white space, case counts. Null texts, short texts and null doc_ids give nothing, rows that
repeat (doc_id and text) count once. Other columns do not matter. All places of a repeat are listed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, joined, long_windows, materialize, mix, NOT_SPACE, text_chunks, tidied, word_hashes, words, workers

BLOCK = 25
MIN_WORDS = 2 * BLOCK
RANGE_WINDOWS = 2_000_000  # windows of one hash range
BATCH_WINDOWS = 1_500_000
BYTES_PER_WORD = 6
PIECE = "part int, batch long, hashes binary, gaps binary, docs binary, sigs binary, counts binary"
_NAMES = ["part", "batch", "hashes", "gaps", "docs", "sigs", "counts"]
_KINDS = [pa.int32(), pa.int64()] + [pa.binary()] * 5


def pack_gaps(at: np.ndarray) -> bytes:
    """Rising places as gaps of 1, 2 or 4 bytes; the first byte tells which."""
    gap = np.diff(at, prepend=0)
    most = int(gap.max()) if len(gap) else 0
    wide = 1 if most < 256 else 2 if most < 65536 else 4
    return bytes([wide]) + as_bytes(gap.astype({1: np.uint8, 2: np.uint16, 4: np.uint32}[wide]))


def unpack_gaps(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32}[raw[0]], offset=1), dtype=np.int64)


def _pack(h: np.ndarray, width: int) -> bytes:
    return as_bytes(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :width])


def _unpack(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view(np.uint64).ravel()


def _signature(h: np.ndarray) -> np.int64:
    return mix(np.array([(h * (np.arange(1, len(h) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))).sum(dtype=np.uint64) + np.uint64(len(h))], np.uint64)).astype(np.int64)[0]


class _Pieces:
    """Collects windows of documents and turns them into rows by hash range. A document's places start
    where the one's before end; `counts` are the places each has."""

    def __init__(self, ranges: int, width: int):
        self.ranges, self.width, self.seq = ranges, width, 0
        self.clear()

    def clear(self):
        self.hashes, self.places, self.docs, self.sigs, self.counts, self.next = [], [], [], [], [], 0

    def add(self, doc, sig, hashes, places, count):
        self.hashes.append(hashes)
        self.places.append(places + self.next)
        self.docs.append(doc)
        self.sigs.append(sig)
        self.counts.append(count)
        self.next += count

    def flush(self):
        h, at = np.concatenate(self.hashes), np.concatenate(self.places)
        # the batch is named by where it is read: a task that runs again names it the same
        batch = (TaskContext.get().partitionId() << 24) + self.seq
        self.seq += 1
        part = ((h >> np.uint64(40)) * np.uint64(self.ranges) >> np.uint64(24)).astype(np.int32)
        order = np.argsort(part.astype(np.uint16) if self.ranges < 65536 else part, kind="stable")
        part, h, at = part[order], h[order], at[order]
        cut = np.append(np.append(0, np.flatnonzero(np.diff(part)) + 1), len(part))
        rows = [(int(part[a]), batch, _pack(h[a:b], self.width), pack_gaps(at[a:b]), None, None, None) for a, b in zip(cut, cut[1:]) if b > a]
        rows.append((-1 - batch % self.ranges, batch, None, None, as_bytes(np.array(self.docs, np.int64)), as_bytes(np.array(self.sigs, np.int64)), as_bytes(np.array(self.counts, np.int64))))
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=_NAMES)


def _probe(ranges: int):
    def run(batches):
        pieces = _Pieces(ranges, 5)
        for batch in batches:
            ids = batch.column(0)
            known = ~np.asarray(ids.is_null())
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                start, end, row = words(data, offsets, NOT_SPACE)
                h = word_hashes(data, start, end)
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                w, first = long_windows(h, row, BLOCK)
                wat = np.searchsorted(first, at)
                for r in np.flatnonzero((np.diff(at) >= MIN_WORDS) & known[lo:hi]):
                    a, b = wat[r], wat[r + 1]
                    place = np.arange(b - a)
                    # the lowest bit tells a reference block from a mere window
                    pieces.add(ids[lo + r], _signature(h[at[r] : at[r + 1]]), (w[a:b] & ~np.uint64(1)) | (place % BLOCK == 0).astype(np.uint64), place, b - a)
                    if pieces.next > BATCH_WINDOWS:
                        yield pieces.flush()
        if pieces.docs:
            yield pieces.flush()

    return run


def _shared(width: int, anchored: bool):
    """Of one hash range, the places whose hash stands at two places or more, with a reference block
    among them if `anchored`. Tables of batches are passed on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["part"].iloc[0] < 0:
            return pdf[["batch", "gaps", "docs", "sigs", "counts"]]
        pdf = pdf.sort_values("batch")
        h = np.concatenate([_unpack(x, width) for x in pdf["hashes"]])
        sizes = np.array([len(x) // width for x in pdf["hashes"]])
        order = np.argsort(h)
        key = h[order] >> np.uint64(1) if anchored else h[order]
        head = np.append(True, key[1:] != key[:-1])
        at = np.flatnonzero(head)
        n = np.diff(np.append(at, len(key)))
        good = n > 1
        if anchored:
            good &= np.add.reduceat((h[order] & np.uint64(1)).astype(np.int64), at) > 0
        hit = np.zeros(len(h), bool)
        hit[order] = np.repeat(good, n)
        ends = np.cumsum(sizes)
        out = []
        for batch, gaps, a, b in zip(pdf["batch"], pdf["gaps"], ends - sizes, ends):
            if hit[a:b].any():
                out.append((batch, pack_gaps(unpack_gaps(gaps)[hit[a:b]]), None, None, None))
        return pd.DataFrame(out, columns=["batch", "gaps", "docs", "sigs", "counts"])

    return run


def _places(result):
    """Per batch, `result(doc, sig, places of the document)` rows of every document that has any."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf[pdf["docs"].notna()].iloc[0]
        hits = [unpack_gaps(x) for x in pdf["gaps"] if x is not None]
        rows = []
        if hits:
            at = np.sort(np.concatenate(hits))
            docs, sigs, counts = (np.frombuffer(side[c], np.int64) for c in ("docs", "sigs", "counts"))
            ends = np.cumsum(counts)
            which = np.searchsorted(ends, at, "right")
            cut = np.searchsorted(which, np.arange(len(docs) + 1))
            for k in np.flatnonzero(np.diff(cut)):
                rows += result(int(docs[k]), int(sigs[k]), at[cut[k] : cut[k + 1]] - (ends[k] - counts[k]))
        return rows

    return run


def _hit_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(_places(lambda d, s, at: [(d, s, pack_gaps(at))])(pdf), columns=["doc_id", "sig", "places"])


def _stretch_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    def runs(d, s, at):
        cut = np.flatnonzero(np.diff(at) > MIN_WORDS)
        a, b = np.append(at[0], at[cut + 1]), np.append(at[cut], at[-1])
        return [(d, int(x), int(y - x) + MIN_WORDS) for x, y in zip(a, b)]

    return pd.DataFrame(_places(runs)(pdf), columns=["doc_id", "start_word", "n_words"])


def _extend(ranges: int):
    """Stretches of MIN_WORDS words that hold a hit, of documents with their hits."""

    def run(batches):
        pieces = _Pieces(ranges, 8)
        for batch in batches:
            ids, sigs, hits = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for lo, hi, data, offsets in text_chunks(batch.column(3)):
                start, end, row = words(data, offsets, NOT_SPACE)
                h = word_hashes(data, start, end)
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                w, first = long_windows(h, row, MIN_WORDS)
                wat = np.searchsorted(first, at)
                for r in range(hi - lo):
                    n = wat[r + 1] - wat[r]
                    if n <= 0 or _signature(h[at[r] : at[r + 1]]) != sigs[lo + r]:
                        continue
                    hit = unpack_gaps(hits[lo + r].as_py())
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, np.minimum(n, np.maximum(0, hit - BLOCK)), 1)
                    np.add.at(edge, np.minimum(n, hit + 1), -1)
                    place = np.flatnonzero(np.cumsum(edge)[:n])
                    if len(place):
                        pieces.add(ids[lo + r], sigs[lo + r], w[wat[r] + place], place, n)
                    if pieces.next > BATCH_WINDOWS:
                        yield pieces.flush()
        if pieces.docs:
            yield pieces.flush()

    return run


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, n_words) of every maximal repeated stretch; see the module for each edge case."""
    workers(docs)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bytes_in = base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = max(1, math.ceil(bytes_in / BYTES_PER_WORD / RANGE_WINDOWS))
    kept = "batch long, gaps binary, docs binary, sigs binary, counts binary"
    probed = base.mapInArrow(tidied(_probe(ranges)), PIECE).groupBy("part").applyInPandas(_shared(5, True), kept)
    hits = materialize(probed, "repeat-hits")
    places = hits.groupBy("batch").applyInPandas(_hit_rows, "doc_id long, sig long, places binary")
    where = materialize(places.groupBy("doc_id", "sig").agg(F.first("places").alias("places")), "repeat-places")
    texts = where.join(base.where("doc_id is not null"), "doc_id").groupBy("doc_id", "sig", "text").agg(F.first("places").alias("places"))
    cut = texts.select("doc_id", "sig", "places", "text").mapInArrow(tidied(_extend(ranges)), PIECE)
    found = materialize(cut.groupBy("part").applyInPandas(_shared(8, False), kept), "repeat-stretches")
    return found.groupBy("batch").applyInPandas(_stretch_rows, "doc_id long, start_word int, n_words int")


SQL = r"""
with w as (select distinct doc_id, list_filter(string_split_regex(text, '[ \t\n\f\r]+'), lambda x: x <> '') as w from documents where doc_id is not null and text is not null),
x as (select doc_id, hash(w) as k, unnest(range(0, len(w) - 49)) as i, unnest(list_transform(range(0, len(w) - 49), lambda i: hash(array_to_string(w[i + 1:i + 50], ' ')))) as h from w where len(w) >= 50),
r as (select doc_id, k, i from x where h in (select h from x group by h having count(*) > 1)),
g as (select *, case when i - lag(i) over w <= 50 then 0 else 1 end as fresh from r window w as (partition by doc_id, k order by i)),
s as (select *, sum(fresh) over (partition by doc_id, k order by i) as run from g)
select doc_id, min(i)::int as start_word, (max(i) - min(i) + 50)::int as n_words from s group by doc_id, k, run
"""
