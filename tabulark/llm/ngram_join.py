"""N-gram Jaccard join by vertical partitioning.

A document is the set of its word n-grams. One total order over all n-grams (rare before frequent,
then by hash) is cut into fragments. Each document's prefix of that order goes, piece by piece, to the
fragments; every fragment counts on its own how many n-grams two sets share in it, and the counts are
summed per pair. Of a set with very many copies only the first document takes part. A pair whose sum can still reach the threshold is a candidate; no pair of Jaccard >=
threshold can be missed. A fragment knows a gram by 32 bits, which can only add candidates.

Large groups of near copies would have as many pairs in every fragment as the square of their sets. They are known
beforehand as families, by tags that many sets share: all pairs of a family are candidates, and no fragment counts
them. Which sets make a family only decides the way that a pair becomes a candidate, never whether it is a link.

Candidates are then counted in full. A set's label is the smallest set among it and its candidates; a pair
belongs to the block of its smaller set's label, and each set goes, as its text, once to each of its blocks.
A block counts all its pairs by products of 0/1 matrices, tile by tile, on 64-bit hashes of the n-grams, and
says for each set how many others it is linked to and whom it hangs together with: what leaves a block is
linear in its sets, however many links they have. Blocks of more than TILE sets are cut into pairs of tiles,
each a task of its own.

Defined results: words are runs without ASCII white space, in lower case. A text of fewer than n words
is one n-gram of all its words. near_classes gives a row for each document and set: class_id is the smallest
doc_id that is connected to it by links, n_links the number of other sets at Jaccard >= threshold, n_copies the
number of doc_ids with the same set, itself included. Null, empty and blank texts have no n-grams and link
nothing: their class is their own. Rows with a null doc_id are left out. Repeated rows count once, a set is
never linked to itself; ties do not matter, as no order enters the result. Empty tables give no rows. Texts of
any length count whole. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import NOT_SPACE, Scratch, as_bytes, delete, joined, materialize, mix, one_of_repeated, text_chunks, tidied, trimmed, window_hash, windows, without, word_hashes, words, workers

NGRAM, THRESHOLD = 3, 0.5
BUCKET_BITS = 23  # size of the frequency sketch: it doesn't grow with the data
SKETCH_ROWS = 64
FRAGMENT_TOKENS = 2_000_000
BANDS = 6  # tags of a set
FAMILY, FAMILY_TAGS = 64, 100_000  # sets that share a tag, from which on it makes a family; the tags with most sets
HOT_RUN = 64  # sets that share a gram, from which on they are counted by matrices
HOT_SETS, HOT_COPIES = 100_000, 50  # the sets with most copies, which only their first document sends
BUCKETS = 1  # of pairs to be summed, for each fragment
LISTED = 256
HELD = 3_000_000  # pairs that are held before equal ones are summed
ROUNDS = 2  # in which blocks are counted: what one round shuffles is gone when the next begins
TILE, INNER = 8_192, 1_024  # sets of a task's tile, and of the products in it
TASK_TEXT = 12_000_000  # characters of small blocks that are counted together
BROADCAST_ROWS = 1_000_000  # sets to be read again are looked up in a broadcast table up to so many, else by a join
_EPS = 1e-9


def _least(n, t):
    """Smallest overlap a set of n needs for Jaccard t."""
    return np.ceil(t * n - _EPS).astype(np.int64)


def _prefix(n, t):
    return n - _least(n, t) + 1


def _grams(data, offsets, n):
    """n-gram hashes and where each row's run of them starts."""
    start, end, row = words(data, offsets, NOT_SPACE)
    h = word_hashes(data, start, end)
    g, first = windows(h, row, n)
    count = np.bincount(row, minlength=len(offsets) - 1)
    short = np.flatnonzero((count > 0) & (count < n))
    at = row[first]
    if len(short):
        word_at = np.concatenate([[0], np.cumsum(count)])
        extra = np.array([window_hash(np.append(h[word_at[r] : word_at[r + 1]], np.uint64(count[r]))) for r in short], np.uint64)
        g, at = np.concatenate([g, extra]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        g, at = g[order], at[order]
    return g, np.searchsorted(at, np.arange(len(offsets)))


def _sets(batch, n, keep=None):
    """(row, sorted n-gram hashes) of every row of a batch that has any and a doc_id."""
    ids = batch.column(0)
    known = ~np.asarray(ids.is_null())
    if keep is not None:
        known &= keep(ids.fill_null(0).to_numpy(zero_copy_only=False))
    for lo, _hi, data, offsets in text_chunks(batch.column(1) if keep is None else pa.array(np.where(known, batch.column(1).to_numpy(zero_copy_only=False), None), pa.large_string())):
        g, at = _grams(data, offsets, n)
        for r in range(len(offsets) - 1):
            if at[r + 1] > at[r] and known[lo + r]:
                yield lo + r, np.unique(g[at[r] : at[r + 1]])


def _signature(g):
    with np.errstate(over="ignore"):
        return mix(np.array([g.sum(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(g))], np.uint64)).astype(np.int64)[0]


_PLACES = np.array([(k << 64) // (2 * BANDS) for k in range(2 * BANDS)], np.uint64)


def _tags(g):
    """BANDS hashes, each of two n-grams of a set: those that come first from fixed places on."""
    at = g[np.searchsorted(g, _PLACES) % len(g)]
    return mix(mix(at[::2] + np.arange(BANDS, dtype=np.uint64)) + at[1::2]).astype(np.int64)


def _family_of(tags, families):
    """The family of the first of the tags that has one, else 0."""
    name, family = families
    if not len(name):
        return 0
    at = np.minimum(np.searchsorted(name, tags), len(name) - 1)
    hit = np.flatnonzero(name[at] == tags)
    return int(family[at[hit[0]]]) if len(hit) else 0


def _stage_sizes(n):
    names = ["block", "doc_id", "n", "sig", "tags", "counts"]

    def run(batches):
        sketch = np.zeros(1 << BUCKET_BITS, np.uint32)
        for batch in batches:
            ids, out, held = batch.column(0), [], []
            for r, g in _sets(batch, n):
                out.append((ids[r].as_py(), len(g), int(_signature(g)), as_bytes(_tags(g))))
                held.append(g)
                if len(held) == 256:
                    np.add.at(sketch, np.concatenate(held) >> np.uint64(64 - BUCKET_BITS), np.uint32(1))
                    held = []
            if held:
                np.add.at(sketch, np.concatenate(held) >> np.uint64(64 - BUCKET_BITS), np.uint32(1))
            if out:
                d, k, s, t = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(d), pa.int32()), pa.array(d, pa.int64()), pa.array(k, pa.int64()), pa.array(s, pa.int64()), pa.array(t, pa.binary()), pa.nulls(len(d), pa.binary())], names=names)
        if sketch.any():
            parts = np.split(sketch, SKETCH_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_ROWS), pa.int32()), *(pa.nulls(SKETCH_ROWS, pa.int64()) for _ in range(3)), pa.nulls(SKETCH_ROWS, pa.binary()), pa.array([zlib.compress(as_bytes(x), 1) for x in parts], pa.binary())], names=names)

    return run


def _add_counts(usual: float):
    """Class of each sketch bucket of a block, and the tokens of each class."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BUCKET_BITS) // SKETCH_ROWS, np.int64)
        for batch in batches:
            for cell in batch.column("counts"):
                total += np.frombuffer(zlib.decompress(cell.as_py()), np.uint32)
        rank = np.clip(np.floor(4 * np.log2(np.maximum(total, 1) / usual)), 0, 31).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([as_bytes(rank)], pa.binary()), pa.array([as_bytes(np.bincount(rank, weights=total, minlength=32))], pa.binary())], names=["block", "ranks", "tokens"])

    return run


def global_order(sizes: DataFrame, fragment_tokens: int):
    """(class of each sketch bucket, pivots that cut the order). The frequency of an n-gram is known up
    to its bucket, which only moves its place in the order: any total order gives the same pairs."""
    usual = max(1.0, (sizes.agg(F.sum("n")).first()[0] or 0) / (1 << BUCKET_BITS))
    found = sizes.where("block is not null").select("block", "counts").groupBy("block").applyInArrow(_add_counts(usual), "block int, ranks binary, tokens binary").collect()
    rank, tokens = np.zeros((SKETCH_ROWS, (1 << BUCKET_BITS) // SKETCH_ROWS), np.uint8), np.zeros(32)
    for row in found:
        rank[row["block"]] = np.frombuffer(row["ranks"], np.uint8)
        tokens += np.frombuffer(row["tokens"])
    rank = rank.ravel()
    pivots = []
    for c in range(32):
        parts = max(1 if c == 0 else 0, math.ceil(tokens[c] / 2 / fragment_tokens))
        pivots += [(c << 59) + (((1 << 59) * i) // parts) for i in range(parts)]
    return rank, np.array(sorted(pivots)[1:], np.uint64)


def families_of(sizes: DataFrame):
    """(tags in order, family of each). Tags that FAMILY sets or more share have one; it is the same where one of two
    tags is, by half of its sets or more, on sets that have the other too."""
    tags = sizes.where("block is null").dropDuplicates(["sig"]).select("sig", "tags")
    each = tags.select("sig", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.substring("tags", 8 * k + 1, F.lit(8)))).alias("tag"))
    heavy = each.groupBy("tag").count().where(F.col("count") >= FAMILY).orderBy(F.desc("count"), "tag").limit(FAMILY_TAGS).toArrow()
    if not heavy.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    name, count = joined(heavy["tag"].to_pylist(), np.int64), heavy["count"].to_numpy()
    order = np.argsort(name)
    name, count = name[order], count[order]

    def run(batches):
        for batch in batches:
            have = joined(batch.column("tags").to_pylist(), np.int64)
            at = np.minimum(np.searchsorted(name, have), len(name) - 1)
            at = np.where(name[at] == have, at, -1).reshape(-1, BANDS)
            a, b = (np.concatenate(x) for x in zip(*((at[:, i], at[:, j]) for i in range(BANDS) for j in range(i))))
            ok = (a >= 0) & (b >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    both = tags.mapInArrow(tidied(run), "a long, b long").groupBy("a", "b").count().where(F.col("count") >= FAMILY // 2).toArrow()
    a, b, c = (both[x].to_numpy() for x in ("a", "b", "count"))
    near = 2 * c >= np.minimum(count[a], count[b])
    root = np.arange(len(name))
    while True:
        before = root.copy()
        low = np.minimum(root[a[near]], root[b[near]])
        np.minimum.at(root, a[near], low)
        np.minimum.at(root, b[near], low)
        root = root[root]
        if np.array_equal(root, before):
            return name, (root + 1).astype(np.int32)


def _kin(families):
    """(sig, family) of the sets that have one."""

    def run(batches):
        for batch in batches:
            f = np.array([_family_of(np.frombuffer(x, np.int64), families) for x in batch.column("tags").to_pylist()], np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("sig").filter(pa.array(f > 0)), pa.array(f[f > 0])], names=["sig", "family"])

    return run


def _keys(g, rank):
    """Place in the global order: 5 bits of frequency class, then 59 bits of hash."""
    return (rank[g >> np.uint64(64 - BUCKET_BITS)].astype(np.uint64) << np.uint64(59)) | (g >> np.uint64(5))


def _cut(rank, pivots, n, t, hot, families):
    hot_sig, hot_first = hot
    names = ["fragment", "sigs", "sizes", "families", "lens", "keys"]

    def flush(keys, sig, size, family):
        lens = np.array([len(k) for k in keys])
        owner, key = np.repeat(np.arange(len(keys)), lens), np.concatenate(keys)
        sig, size, family = np.array(sig, np.int64), np.array(size, np.int32), np.array(family, np.int32)
        piece = np.searchsorted(pivots, key, "right").astype(np.int32)
        order = np.argsort(piece, kind="stable")
        piece, owner, key = piece[order], owner[order], key[order]
        cut = np.flatnonzero(np.diff(piece)) + 1
        rows = []
        for a, b in zip(np.append(0, cut), np.append(cut, len(piece))):
            head = np.append(a, np.flatnonzero(np.diff(owner[a:b])) + a + 1)
            who = owner[head]
            rows.append((int(piece[a]), as_bytes(sig[who]), as_bytes(size[who]), as_bytes(family[who]), as_bytes(np.diff(np.append(head, b)).astype(np.int32)), as_bytes(key[a:b].astype(np.uint32))))
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), [pa.int32()] + [pa.binary()] * 5)], names=names)

    def run(batches):
        keys, sig, size, family, held = [], [], [], [], 0
        for batch in batches:
            for r, g in _sets(batch, n):
                own = _signature(g)
                at = np.searchsorted(hot_sig, own)
                if at < len(hot_sig) and hot_sig[at] == own and batch.column(0)[r].as_py() != hot_first[at]:
                    continue
                k = np.sort(_keys(g, rank))[: int(_prefix(np.int64(len(g)), t))]
                keys.append(k)
                sig.append(own)
                size.append(len(g))
                family.append(_family_of(_tags(g), families))
                held += len(k)
                if held > 1_500_000:
                    yield flush(keys, sig, size, family)
                    keys, sig, size, family, held = [], [], [], [], 0
        if keys:
            yield flush(keys, sig, size, family)

    return run


def _needs(na, nb, t):
    """Prefix overlap that a pair must have to reach Jaccard t: overlap needed, less all that may lie
    behind the shorter-reaching prefix."""
    over = np.ceil(t / (1 + t) * (na + nb) - _EPS).astype(np.int64)
    return np.maximum(1, over - np.maximum(_least(na, t), _least(nb, t)) + 1)


_PAIRS = "bucket int, frequent boolean, names binary, sizes binary, a binary, b binary, c binary"
_PAIR_SCHEMA = pa.schema([("bucket", pa.int32()), ("frequent", pa.bool_()), *((x, pa.binary()) for x in ("names", "sizes", "a", "b", "c"))])
_ROW = 1 << 32  # in a sum, one count of n-grams that are not frequent


def _bucketed(name, n, a, b, c, buckets, frequent):
    """Pairs of places in name, packed by the bucket of a."""
    bucket = (mix(name.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)[a]
    order = np.argsort(bucket, kind="stable")
    a, b, c, bucket = a[order], b[order], c[order], bucket[order]
    rows = []
    cut = np.flatnonzero(np.diff(bucket)) + 1
    for lo, hi in zip(np.append(0, cut), np.append(cut, len(bucket))):
        used, at = np.unique(np.concatenate([a[lo:hi], b[lo:hi]]), return_inverse=True)
        at = at.astype(np.int32)
        rows.append((int(bucket[lo]), frequent, as_bytes(name[used]), as_bytes(n[used].astype(np.int32)), as_bytes(at[: hi - lo]), as_bytes(at[hi - lo :]), as_bytes(c[lo:hi].astype(np.int32))))
    return rows


def _cells(table, name):
    return table.column(name).to_pylist()


class _Sums:
    """Counts of pairs by code. Equal codes are summed when as many came as are held already, HELD at least, so each
    count is summed anew a few times, however many pairs are apart. With split, sums of HELD pairs or more are given
    out before all have come: a pair may then be given out several times."""

    def __init__(self, split: bool):
        self.split, self.codes, self.counts, self.kept, self.fresh = split, [], [], 0, 0

    def add(self, codes, counts):
        """(codes, counts) to be given out now, none or one of them."""
        self.codes.append(codes)
        self.counts.append(counts)
        self.fresh += len(codes)
        if self.fresh > max(HELD, self.kept):
            self.codes, self.counts = _folded(self.codes, self.counts)
            self.kept, self.fresh = len(self.codes[0]), 0
            if self.split and self.kept > HELD:
                yield from self.rest()

    def rest(self):
        if self.codes:
            yield from zip(*_folded(self.codes, self.counts))
        self.codes, self.counts, self.kept, self.fresh = [], [], 0, 0


def _pair_events(key, owner, size, t, wide, split):
    """(code of the pair, its count) of all pairs in the same run of keys, sizes ascending in each run; split: see _Sums."""
    i, d, sums = np.arange(len(key)), 1, _Sums(split)
    while True:
        i = i[i + d < len(key)]
        j = i + d
        ok = (key[i] == key[j]) & (size[i] >= t * size[j] - _EPS)
        i, j = i[ok], j[ok]
        if not len(i):
            break
        yield from sums.add(np.minimum(owner[i], owner[j]).astype(np.int64) * wide + np.maximum(owner[i], owner[j]), np.ones(len(i), np.int32))
        d += 1
    yield from sums.rest()


def _apart_events(key, owner, family, size, t, wide):
    """As _pair_events with split, without the pairs of one family: a run has its entries by family, those without one (0) first."""
    fresh = np.append(True, (key[1:] != key[:-1]) | (family[1:] != family[:-1]))[: len(key)]
    head = np.flatnonzero(fresh)
    i, sums = np.arange(len(key)), _Sums(True)
    j = np.where(family > 0, np.append(head[1:], len(key))[np.cumsum(fresh) - 1], i + 1)
    while True:
        ok = j < len(key)
        i, j = i[ok], j[ok]
        ok = key[i] == key[j]
        i, j = i[ok], j[ok]
        if not len(i):
            break
        ok = np.minimum(size[i], size[j]) >= t * np.maximum(size[i], size[j]) - _EPS
        p, q = owner[i[ok]], owner[j[ok]]
        yield from sums.add(np.minimum(p, q).astype(np.int64) * wide + np.maximum(p, q), np.ones(len(p), np.int32))
        j = j + 1
    yield from sums.rest()


def _hang_together(run, owner):
    """For each entry the smallest owner that hangs together with it through shared runs."""
    u, own = np.unique(owner, return_inverse=True)
    label = np.arange(len(u))
    order = np.argsort(own, kind="stable")
    run_head, own_head = np.flatnonzero(np.append(True, np.diff(run) != 0)), np.flatnonzero(np.append(True, np.diff(own[order]) != 0))
    spread = np.cumsum(np.append(False, np.diff(run) != 0))
    while True:
        low = np.minimum.reduceat(label[own], run_head)[spread]
        new = np.minimum.reduceat(low[order], own_head)
        new = new[new]
        if np.array_equal(new, label):
            return u[label[own]]
        label = new


def _count_fragment(fragments: int, t: float, buckets: int, turn: int = 0, rounds: int = 1):
    """Partial overlaps of one fragment, of the pairs whose smaller set has its turn in this round and that are not of one
    family. N-grams that sets of a family have are counted apart, and so are those that HOT_RUN sets or more share: sets that hang
    together through them, as near copies do, by products of 0/1 matrices where that is less work than pair by pair.
    Of the others a count of 1 is not sent for pairs that need more than one in each fragment; the sum adds it back,
    as an upper bound, for each fragment that sent none. Pairs leave in tables of about HELD."""

    def run(table: pa.Table) -> Iterator[pa.Table]:
        sig, size, family = joined(_cells(table, "sigs"), np.int64), joined(_cells(table, "sizes"), np.int32), joined(_cells(table, "families"), np.int32)
        owner, key = np.repeat(np.arange(len(sig), dtype=np.int32), joined(_cells(table, "lens"), np.int32)), joined(_cells(table, "keys"), np.uint32)
        del table
        order = np.argsort(key)
        key, owner = key[order], owner[order]
        same = key[1:] == key[:-1]
        shared = (np.append(same, False) | np.append(False, same))[: len(key)]
        key, owner = key[shared], owner[shared]
        del order, same, shared
        rows, waiting = [], 0
        if len(key):
            used = np.zeros(len(sig), bool)
            used[owner] = True
            owner = (np.cumsum(used) - 1)[owner]
            sig, size, family = sig[used], size[used], family[used]
            name, doc = np.unique(sig, return_inverse=True)
            n, of = np.zeros(len(name), np.int64), np.zeros(len(name), np.int32)
            n[doc] = size
            of[doc] = family
            owner = doc[owner]
            del sig, size, family, used, doc
            order = np.lexsort((owner, n[owner], key))
            key, owner = key[order], owner[order]
            fresh = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))
            key, owner = key[fresh], owner[fresh]
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            many = np.diff(np.append(head, len(key)))
            kin = np.repeat(np.maximum.reduceat(of[owner], head) > 0, many)
            many = np.repeat(many, many)
            wide = np.int64(len(name))
            own_turn = (mix(name.view(np.uint64)) >> np.uint64(40)) % np.uint64(rounds) == turn

            def send(a, b, c, frequent):
                nonlocal rows, waiting
                ok = own_turn[a] & (frequent | (c > 1) | (_needs(n[a], n[b], t) <= fragments))
                for lo in range(0, len(a), HELD):
                    part = np.flatnonzero(ok[lo : lo + HELD]) + lo
                    if len(part):
                        rows.extend(_bucketed(name, n, a[part], b[part], c[part], buckets, frequent))
                        waiting += len(part)
                    if waiting >= HELD:
                        yield _pair_table(rows)
                        rows, waiting = [], 0

            def one_by_one(pick, frequent):
                for code, c in _pair_events(key[pick], owner[pick], n[owner[pick]], t, wide, frequent):
                    yield from send(code // wide, code % wide, c, frequent)

            if kin.any():
                at = np.flatnonzero(kin)
                at = at[np.lexsort((of[owner[at]], key[at]))]
                for code, c in _apart_events(key[at], owner[at], of[owner[at]], n[owner[at]], t, wide):
                    yield from send(code // wide, code % wide, c, True)
            yield from one_by_one(~kin & (many < HOT_RUN), False)
            at = np.flatnonzero(~kin & (many >= HOT_RUN))
            if len(at):
                group = _hang_together(key[at], owner[at])
                order = np.argsort(group, kind="stable")
                at, group = at[order], group[order]
                cut = np.append(np.append(0, np.flatnonzero(np.diff(group)) + 1), len(group))
                rest = []
                for lo, hi in zip(cut, cut[1:]):
                    part = at[lo:hi]
                    u, own = np.unique(owner[part], return_inverse=True)
                    if len(u) ** 2 > 4 * many[part].sum():
                        rest.append(part)
                        continue
                    col = np.cumsum(np.append(False, np.diff(key[part].astype(np.int64)) != 0))
                    for a, b, c in _products(own, col, int(col[-1]) + 1, len(u)):
                        na, nb = n[u[a : a + c.shape[0]], None], n[None, u[b : b + c.shape[1]]]
                        ok = (c > 0) & (np.minimum(na, nb) >= t * np.maximum(na, nb) - _EPS)
                        i, j = np.nonzero(np.triu(ok, 1) if a == b else ok)
                        yield from send(u[a + i].astype(np.int64), u[b + j].astype(np.int64), c[i, j].astype(np.int32), True)
                if rest:
                    yield from one_by_one(np.sort(np.concatenate(rest)), True)
        if rows:
            yield _pair_table(rows)

    return run


def _pair_table(rows):
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows), _PAIR_SCHEMA)], schema=_PAIR_SCHEMA)


def _given_out(run):
    """run, of one group's table into several, for applyInArrow: what it has given out is not held any more."""
    whole = tidied(lambda batches: (b for out in run(pa.Table.from_batches(batches)) for b in out.to_batches()))

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from whole(batches)

    return inner


def _folded(codes, counts):
    u, inv = np.unique(np.concatenate(codes), return_inverse=True)
    return [u], [np.bincount(inv, weights=np.concatenate(counts)).astype(np.int64)]


_NEAR = pa.schema([("sig", pa.int64()), ("others", pa.list_(pa.int64()))])


def _sum_bucket(fragments: int, t: float):
    """Candidates (sig, others above it) of a bucket: sums of the partial overlaps that can still reach t."""

    def run(table: pa.Table) -> pa.Table:
        names = [np.frombuffer(x, np.int64) for x in _cells(table, "names")]
        every, at = np.unique(np.concatenate(names), return_inverse=True)
        n = np.zeros(len(every), np.int64)
        n[at] = joined(_cells(table, "sizes"), np.int32)
        base = np.cumsum([0, *map(len, names)])
        sums = _Sums(False)
        for k, (frequent, a, b, c) in enumerate(zip(*(_cells(table, x) for x in ("frequent", "a", "b", "c")))):
            own = at[base[k] : base[k + 1]].astype(np.int64)
            for _ in sums.add(own[np.frombuffer(a, np.int32)] * len(every) + own[np.frombuffer(b, np.int32)], np.frombuffer(c, np.int32) + np.int64(0 if frequent else _ROW)):
                pass
        code, c = next(sums.rest())
        a, b = code // len(every), code % len(every)
        need = _needs(n[a], n[b], t)
        ok = c % _ROW + np.where(need > fragments, fragments - c // _ROW, 0) >= need
        a, b = a[ok], b[ok]
        head = np.flatnonzero(np.append(True, (np.diff(a) != 0))[: len(a)])
        if len(head):  # a list has LISTED others at most
            own = np.repeat(head, np.diff(np.append(head, len(a))))
            head = np.flatnonzero((np.arange(len(a)) - own) % LISTED == 0)
        return pa.table([pa.array(every[a[head]]), pa.ListArray.from_arrays(pa.array(np.append(head, len(a)).astype(np.int32)), pa.array(every[b]))], schema=_NEAR)

    return run


def candidates(keyed: DataFrame, fragments: int, t: float, turn: int = 0, rounds: int = 1) -> DataFrame:
    """(sig, others), in lists of LISTED: for each set those above it whose summed partial overlap can still reach t.
    Each set has its turn in one of the rounds."""
    part = keyed.groupBy("fragment").applyInArrow(_given_out(_count_fragment(fragments, t, BUCKETS * fragments, turn, rounds)), _PAIRS)
    return part.groupBy("bucket").applyInArrow(trimmed(_sum_bucket(fragments, t)), "sig long, others array<long>")


def _row_sets(column, n):
    """Sorted n-gram hashes of every row."""
    out = [np.zeros(0, np.uint64)] * len(column)
    for lo, _hi, data, offsets in text_chunks(column):
        g, at = _grams(data, offsets, n)
        for r in range(len(offsets) - 1):
            out[lo + r] = np.unique(g[at[r] : at[r + 1]])
    return out


def _incidence(sets):
    """(owner, column, columns) of the grams that two sets or more have, sorted by column."""
    owner = np.repeat(np.arange(len(sets)), [len(g) for g in sets])
    _, inv, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    ok = shared[inv]
    col = (np.cumsum(shared) - 1)[inv[ok]]
    order = np.argsort(col, kind="stable")
    return owner[ok][order], col[order], int(shared.sum())


def _matrix(owner, col, lo, hi, a, b):
    """0/1 matrix of the rows a..b and columns lo..hi."""
    p, q = np.searchsorted(col, (lo, hi))
    o, c = owner[p:q], col[p:q]
    ok = (o >= a) & (o < b)
    x = np.zeros((b - a, hi - lo), np.float32)
    x[o[ok] - a, c[ok] - lo] = 1
    return x


def _products(owner, col, width, rows, between=None):
    """(first row, first column, overlap matrix) of each pair of inner tiles of a 0/1 matrix, given by its ones sorted
    by column. between: the first `between` rows against the others only."""
    for a in range(0, rows, INNER):
        ea = min(a + INNER, rows)
        for b in range(a, rows, INNER):
            eb = min(b + INNER, rows)
            if between is not None and (a >= between or eb <= between):
                continue
            step = max(64, 3_000_000 // max(ea - a, eb - b))
            c = np.zeros((ea - a, eb - b), np.float32)
            for lo in range(0, width, step):
                hi = min(width, lo + step)
                x = _matrix(owner, col, lo, hi, a, ea)
                c += x @ (x if a == b else _matrix(owner, col, lo, hi, b, eb)).T
            yield a, b, c


def _tiles(sets, between=None):
    """As _products, with the Jaccard of each pair of sets."""
    n = np.array([len(g) for g in sets], np.int64)
    for a, b, c in _products(*_incidence(sets), len(sets), between):
        yield a, b, c / np.maximum(n[a : a + c.shape[0], None] + n[None, b : b + c.shape[1]] - c, 1).astype(np.float64)


def _merge(root, near, a, b):
    """Roots of all sets, with the links of one tile added: two sweeps by minima, and what they leave one by one."""
    rows, cols = np.arange(a, a + near.shape[0]), np.arange(b, b + near.shape[1])
    none = len(root)

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    for _ in range(2):
        low = np.minimum(root[rows], np.where(near, root[cols][None, :], none).min(1, initial=none))
        for x in np.flatnonzero(low < root[rows]):
            p, q = find(rows[x]), find(low[x])
            root[max(p, q)] = min(p, q)
        _flatten(root)
    i, j = np.nonzero(near & (root[rows][:, None] != root[cols][None, :]))
    for p, q in np.unique(np.stack([root[rows[i]], root[cols[j]]], 1), axis=0).tolist():
        p, q = find(p), find(q)
        root[max(p, q)] = min(p, q)
    _flatten(root)


def _flatten(root):
    while True:
        up = root[root]
        if np.array_equal(up, root):
            return
        root[:] = up


_LINKS = "sig_a long, sig_b long, n long, jaccard double"
_LINK_SCHEMA = pa.schema([("sig_a", pa.int64()), ("sig_b", pa.int64()), ("n", pa.int64()), ("jaccard", pa.float64())])


def _count_task(n: int, t: float, pairs: bool):
    """For each set of each block of a task (set, root in the block, links counted there); with pairs the links
    themselves (set, other set, 1, jaccard)."""

    def run(table: pa.Table) -> pa.Table:
        block, tile, sig, own = (table.column(x).to_numpy() for x in ("block", "tile", "sig", "label"))
        cross = table.column("ti")[0].as_py() != table.column("tj")[0].as_py()
        sets = _row_sets(table.column("text"), n)
        del table
        ok = np.array([len(g) > 0 and int(_signature(g)) == s for g, s in zip(sets, sig.tolist())], bool)  # a doc_id may have another text too
        order = np.lexsort((sig, tile, block))
        order = order[ok[order]]
        block, tile, sig, own = block[order], tile[order], sig[order], own[order]
        fresh = np.append(True, (block[1:] != block[:-1]) | (sig[1:] != sig[:-1]))[: len(order)]
        order, block, tile, sig, own = order[fresh], block[fresh], tile[fresh], sig[fresh], own[fresh]
        cut = np.append(np.append(0, np.flatnonzero(np.diff(block)) + 1), len(block))
        out = []
        for lo, hi in zip(cut, cut[1:]):
            other = np.flatnonzero(np.diff(tile[lo:hi]))
            if hi - lo < 2 or (cross and not len(other)):
                continue
            s, mine = sig[lo:hi], own[lo:hi] == block[lo]
            links, root = np.zeros(hi - lo, np.int64), np.arange(hi - lo)
            for a, b, j in _tiles([sets[k] for k in order[lo:hi]], int(other[0]) + 1 if len(other) else None):
                ra, rb = np.arange(a, a + j.shape[0]), np.arange(b, b + j.shape[1])
                near = (j >= t - _EPS) & ((ra[:, None] < rb[None, :]) if a == b else True)
                near &= np.where(s[ra][:, None] < s[rb][None, :], mine[ra][:, None], mine[rb][None, :])
                if len(other):
                    near &= tile[lo:hi][ra][:, None] != tile[lo:hi][rb][None, :]
                links[ra] += near.sum(1)
                links[rb] += near.sum(0)
                if pairs:
                    x, y = np.nonzero(near)
                    out.append((s[ra[x]], s[rb[y]], np.ones(len(x), np.int64), j[x, y]))
                elif near.any():
                    _merge(root, near, a, b)
            if not pairs:
                some = links > 0
                out.append((s[some], s[root[some]], links[some], np.ones(int(some.sum()))))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)] if out else [pa.array([], f.type) for f in _LINK_SCHEMA], schema=_LINK_SCHEMA)

    return run


def _sets_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))


def _links(scratch: Scratch, docs: DataFrame, n: int, t: float, fragment_tokens: int, pairs: bool, tile: int, broadcast_rows: int):
    """(doc_id, sig) of every document with n-grams; links as _count_task gives them."""
    base = _sets_of(docs)
    sizes = scratch.write(base.mapInArrow(tidied(_stage_sizes(n)), "block int, doc_id long, n long, sig long, tags binary, counts binary"), "jaccard-sizes")
    rank, pivots = global_order(sizes, fragment_tokens)
    fragments = len(pivots) + 1
    known = sizes.where("block is null").select("doc_id", "sig").distinct()
    hot = known.groupBy("sig").agg(F.count("*").alias("k"), F.min("doc_id").alias("first")).where(F.col("k") > HOT_COPIES).orderBy(F.desc("k"), "sig").limit(HOT_SETS).select("sig", "first").toPandas().sort_values("sig")
    families = families_of(sizes)
    keyed = base.mapInArrow(tidied(_cut(rank, pivots, n, t, (hot["sig"].to_numpy(np.int64), hot["first"].to_numpy(np.int64)), families)), "fragment int, sigs binary, sizes binary, families binary, lens binary, keys binary")
    found = scratch.write(candidates(keyed, fragments, t), "jaccard-candidates")
    kin = scratch.write(sizes.where("block is null").select("sig", "tags").mapInArrow(tidied(_kin(families)), "sig long, family int").distinct(), "jaccard-families")

    first = kin.join(kin.groupBy("family").agg(F.min("sig").alias("m")), "family")
    low = found.select("sig", F.col("sig").alias("m")).union(found.select(F.explode("others").alias("sig"), F.col("sig").alias("m"))).union(first.select("sig", "m"))
    label = low.groupBy("sig").agg(F.min("m").alias("label"))
    of_family = kin.join(label, "sig").select("family", "label").distinct().join(kin, "family").select("label", "sig")
    member = found.join(label, "sig").select("label", F.explode(F.concat("others", F.array("sig"))).alias("sig")).union(of_family).distinct()
    rep = known.groupBy("sig").agg(F.min("doc_id").alias("doc_id"))
    asked = scratch.write(member.withColumnRenamed("label", "block").join(label, "sig").join(rep, "sig").select("doc_id", "sig", "label", "block"), "jaccard-asked")

    large = {r["block"]: -(-r["n"] // tile) for r in asked.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > tile).collect()}  # one row for TILE sets at most
    rows = asked.count()
    volume = sizes.agg(F.sum("n").alias("n"), F.count("sig").alias("k")).first()
    tasks = 1 + int(7 * rows * (volume["n"] or 0) / max(1, volume["k"]) / TASK_TEXT)
    base = base.where("doc_id is not null and text is not null")
    texts = asked.join(base.hint("shuffle_merge"), "doc_id") if rows > broadcast_rows else base.join(F.broadcast(asked), "doc_id")
    many = F.create_map(*[F.lit(x) for item in large.items() for x in item])[F.col("block")].cast("int") if large else F.lit(None).cast("int")
    spread = texts.withColumn("many", many).withColumn("tile", F.when(F.col("many").isNull(), 0).otherwise(F.pmod(F.xxhash64("sig"), F.col("many").cast("long"))).cast("int"))
    spread = spread.withColumn("other", F.explode(F.when(F.col("many").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("many") - 1))))
    # small blocks share a task by hash; of large ones each pair of tiles is one
    task = [F.when(F.col("many").isNull(), F.pmod(F.xxhash64("block"), F.lit(tasks))).otherwise(F.lit(-1)).alias("task"), F.when(F.col("many").isNotNull(), F.col("block")).alias("big"), F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj")]
    tasked = spread.select(*task, "block", "tile", "sig", "label", "text")
    links = None
    for k in range(ROUNDS):
        part = tasked.where(F.pmod(F.xxhash64("block", F.lit(5)), F.lit(ROUNDS)) == k)
        part = scratch.write(part.groupBy("task", "big", "ti", "tj").applyInArrow(trimmed(_count_task(n, t, pairs)), _LINKS), "jaccard-links")
        links = part if links is None else links.union(part)
    return known, rep, links


def near_classes(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, fragment_tokens: int = FRAGMENT_TOKENS, tile: int = TILE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) of every document and set; see the module for each edge case."""
    with Scratch(workers(docs)) as scratch:
        known, rep, links = _links(scratch, docs, n, threshold, fragment_tokens, False, tile, broadcast_rows)
        root = components(scratch, links.select("sig_a", "sig_b"))
        many = known.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"))
        linked = links.groupBy(F.col("sig_a").alias("sig")).agg(F.sum("n").alias("n_links"))
        group = linked.join(root, "sig", "left").select("sig", "n_links", F.coalesce("root", "sig").alias("root"))
        first = group.join(many, "sig").groupBy("root").agg(F.min("rep").alias("first"))
        of_set = many.join(group.join(first, "root"), "sig", "left").select("sig", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("first", "rep").alias("class_id"))
        found = known.join(of_set, "sig").select("doc_id", "class_id", "n_links", "n_copies")
        ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        blank = ids.join(known.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
        return materialize(found.union(blank), "near-classes")


def ngram_jaccard_pairs(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, fragment_tokens: int = FRAGMENT_TOKENS, tile: int = TILE, broadcast_rows: int = BROADCAST_ROWS):
    """Every link, between sets: (doc_id_a < doc_id_b, jaccard) of the smallest doc_ids that have them, and the
    membership (doc_id, set_id): set_id is the smallest doc_id of the same set."""
    with Scratch(workers(docs)) as scratch:
        known, rep, links = _links(scratch, docs, n, threshold, fragment_tokens, True, tile, broadcast_rows)
        a, b = (rep.select(F.col("sig").alias(f"sig_{x}"), F.col("doc_id").alias(f"r{x}")) for x in "ab")
        pairs = links.join(a, "sig_a").join(b, "sig_b").where("ra <> rb").select(F.least("ra", "rb").alias("doc_id_a"), F.greatest("ra", "rb").alias("doc_id_b"), "jaccard").distinct()
        return materialize(pairs, "near-pairs"), materialize(known.join(rep.withColumnRenamed("doc_id", "set_id"), "sig").select("doc_id", "set_id"), "near-members")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(sig, root): the smallest set of each connected group of edges (two columns), by large-star and small-star
    steps (Kiveris et al. 2014), each round written to the shared folder and the one before deleted."""
    u, v = edges.columns
    edges = scratch.write(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct(), "groups")
    before = None
    while True:
        old = scratch.paths.pop()
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small_low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(small_low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("e")).select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct()
        edges = scratch.write(small, "groups")
        delete(scratch.spark, old)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("sig"), F.col("v").alias("root"))


def keep_one_of_each(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """docs without those of another document's class, and one of the rows that are equal in doc_id and text, null
    or not. A doc_id with several texts stays if one of them is the first of its class."""
    gone = classes.groupBy("doc_id").agg(F.min(F.col("class_id") != F.col("doc_id")).alias("all")).where("all").select("doc_id")
    return one_of_repeated(without(docs, gone))


SQL = r"""
with recursive w as (select distinct doc_id, list_filter(string_split_regex(lower(text), '[\t\n\f\r ]+'), lambda x: x <> '') as w
           from documents where doc_id is not null and text is not null),
g as (select distinct doc_id, list_sort(list_distinct(case when len(w) >= 3
        then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
        else [array_to_string(w, ' ')] end)) as s from w where len(w) > 0),
r as (select s, min(doc_id) as rep, count(*) as n_copies, len(s) as n from g group by s),
t as (select rep, n, unnest(s) as x from r),
o as (select a.rep as a, b.rep as b, a.n as na, b.n as nb, count(*) as c from t a join t b on a.x = b.x and a.rep < b.rep group by all),
l as (select a, b from o where c / (na + nb - c)::double >= 0.5 union all select b, a from o where c / (na + nb - c)::double >= 0.5),
reach(a, b) as (select a, b from l union select reach.a, l.b from reach join l on reach.b = l.a),
k as (select a as rep, min(least(a, b)) as class_id from reach group by a),
m as (select a as rep, count(*) as n_links from l group by a)
select g.doc_id, coalesce(k.class_id, r.rep) as class_id, coalesce(m.n_links, 0) as n_links, r.n_copies
from g join r using (s) left join k using (rep) left join m using (rep)
union all select distinct doc_id, doc_id, 0, 1 from documents where doc_id is not null and doc_id not in (select doc_id from g)
"""
