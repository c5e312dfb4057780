"""Quality classifier by positive-unlabelled learning.

Trusted positives (labelled good and not toxic) are a sample of POSITIVES at most, by the hash of doc_id, in three
folds: one to choose features, one to fit, one held out for the prior and the level. Unlabelled text is every document
of the table, as it comes: labelled documents are part of it too. What is learnt from it covers all of it:

1. The document frequency of every feature is counted over all documents. Those whose share among the positives of the
   first fold and among all documents differs by CONTRAST standard errors have weights: thousands of words that tell
   nothing would drown the few that do. All documents are written as lists of those features.
2. Documents fall into groups of about GROUP by a hash; each group fits a model on its own, and their weights are
   averaged by the groups' sizes (Zinkevich et al. 2010), so no task holds more than a group.
3. The class prior: plain positive-against-unlabelled models are fitted on each half of every group and score the other
   half; the scores' histograms add up over all documents. The prior is the smallest ratio, over score levels, of the
   share of all documents above a level to the share of held-out positives above it, with a slack for the numbers.
4. The final linear model minimises the non-negative unbiased risk  pi R_P+ + max(0, R_U- - pi R_P-)  with the logistic
   loss. A document stays if its score is above 0 or above the level that KEEP of the held-out positives reach.

Features: each distinct word (ASCII lower case), and levels of the symbol share, the share of capitals
and the word length.
Defined results: null and blank texts never stay. Without positives (two at least in each fold) or unlabelled text all
others stay, with a null score. Null doc_ids are counted and scored like others but are no positives; repeated rows
count each time and are scored alike; ties of the sample's hash go to the smaller doc_id. Texts count whole, however
long. Other columns do not matter; labels that contradict each other are no trusted positives. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ALNUM, SPACES, Scratch, as_bytes, joined, materialize, text_chunks, tidied, trimmed, word_hashes, words, workers

BITS = 18
LEVELS = 64  # the first hash slots are those of the levels
POSITIVES = 6000  # bound of the sample of labelled rows
GROUP = 50_000  # documents that are fitted together
BLOCKS = 64  # the frequencies are summed in so many parts
BINS, SPAN = 8192, 32.0  # of the histograms of scores, from -SPAN to SPAN
CONTRAST, LEAST_DF, L2, STEPS, KEEP = 4.0, 10, 1e-4, 200, 0.99
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = ~ALNUM & ~SPACES


def features(data, offsets):
    """(row, feature) of the distinct features of every row, sorted by row, then feature."""
    rows = len(offsets) - 1
    low = _LOW[data]
    start, end, row = words(low, offsets, ALNUM)
    f = (word_hashes(low, start, end) >> np.uint64(64 - BITS)).astype(np.int64)
    f[f < 4 * LEVELS] += 4 * LEVELS
    total = lambda mask: np.diff(np.append(0, np.cumsum(mask[data]))[offsets])
    odd, up, dense = total(_SYMBOL), total(_UPPER), total(~SPACES)
    n = np.bincount(row, minlength=rows)
    some = np.maximum(dense, 1)
    level = lambda x, k: k * LEVELS + np.minimum(LEVELS - 1, x.astype(np.int64))
    extra = [level(40 * np.sqrt(odd / some), 0), level(40 * np.sqrt(up / some), 1), level(4 * np.log2(1 + dense / np.maximum(n, 1)), 2)]
    code = np.concatenate([(row.astype(np.int64) << BITS) + f, *((np.arange(rows) << BITS) + x for x in extra)])
    code = np.unique(code)
    return code >> BITS, code & ((1 << BITS) - 1), dense


def _feature_rows(batches):
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, data, offsets in text_chunks(batch.column(1)):
            row, f, dense = features(data, offsets)
            at = np.searchsorted(row, np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array([as_bytes(f[a:b].astype(np.int32)) for a, b in zip(at, at[1:])], pa.binary()), pa.array(dense > 0)], names=["doc_id", "f", "some"])


def _sampled(docs: DataFrame, ids: DataFrame, most: int, seed: int):
    """Feature lists of the documents of `ids` with the smallest hashes, in the order of the hash."""
    order = [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")]
    few = ids.select("doc_id").orderBy(*order).limit(most)
    got = docs.join(F.broadcast(few), "doc_id").select("doc_id", "text").mapInArrow(tidied(_feature_rows), "doc_id long, f binary, some boolean").where("some").select("doc_id", "f").collect()
    unique = {(r["doc_id"], bytes(r["f"])) for r in got}
    return [np.frombuffer(f, np.int32) for _, f in sorted(unique, key=lambda x: (hash_order(x[0]), x))]


def hash_order(doc_id: int) -> int:
    return (doc_id * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 64)


def _frequencies(batches):
    df = np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for lo, hi, data, offsets in text_chunks(batch.column(0)):
            row, f, dense = features(data, offsets)
            df += np.bincount(f[dense[row] > 0], minlength=len(df))
    if df.any():
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([as_bytes(x) for x in np.split(df, BLOCKS)], pa.binary())], names=["block", "part"])


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(pdf["part"].iloc[0]) // 8, np.int64)
    for x in pdf["part"]:
        total += np.frombuffer(x, np.int64)
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [as_bytes(total)]})


def _summed(parts: DataFrame) -> np.ndarray | None:
    rows = sorted(parts.groupBy("block").applyInPandas(_added, "block int, part binary").collect())
    return np.concatenate([np.frombuffer(r["part"], np.int64) for r in rows]) if rows else None


class _Rows:
    """Lists of places of live features: how long each is, and all of them one after another."""

    def __init__(self, n, flat):
        self.n, self.flat = np.asarray(n, np.int64), flat
        self.at = np.append(0, np.cumsum(self.n))

    @classmethod
    def of(cls, lists, column):
        lists = [column[x] for x in lists]
        lists = [x[x >= 0] for x in lists]
        return cls([len(x) for x in lists], np.concatenate(lists) if lists else np.zeros(0, np.int64))

    def some(self, pick):
        return _Rows(self.n[pick], self.flat[np.repeat(pick, self.n)])

    def score(self, w, b):
        total = np.append(0, np.cumsum(w[self.flat]))
        return np.diff(total[self.at]) + b

    def grad(self, g, size):
        return np.bincount(self.flat, weights=np.repeat(g, self.n), minlength=size)


def _sig(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _train(p: _Rows, u: _Rows, size: int, prior: float | None, steps: int = STEPS, l2: float = L2):
    """Weights and bias. prior None: positives against unlabelled; else the non-negative risk."""
    w, b = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    np_, nu = max(1, len(p.n)), max(1, len(u.n))
    for t in range(1, steps + 1):
        sp, su = _sig(p.score(w, b)), _sig(u.score(w, b))
        if prior is None:
            gp, gu = (sp - 1) / np_, su / nu
        else:
            lose = np.mean(-np.log(1 - su + 1e-12)) - prior * np.mean(-np.log(1 - sp + 1e-12))
            if lose >= 0:
                gp, gu = prior * (sp - 1) / np_ - prior * sp / np_, su / nu
            else:  # the part that overfits is walked back
                gp, gu = prior * sp / np_, -su / nu
        g = np.append(p.grad(gp, size) + u.grad(gu, size) + l2 * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def estimate_prior(p_scores, bins) -> float:
    """Smallest ratio of upper tails, with a slack of one standard error; at least a fifth of the positives
    are above any level that counts. bins: the histogram of the scores of all documents."""
    best, many = 1.0, bins.sum()
    above = np.append(np.cumsum(bins[::-1])[::-1], 0)
    p_bin = _bin(p_scores)
    for q in np.linspace(0.01, 0.8, 80):
        t = int(np.quantile(p_bin, q))
        up, uu = (p_bin >= t).mean(), above[t] / many
        slack = np.sqrt(uu * (1 - uu) / many) + np.sqrt(up * (1 - up) / len(p_scores))
        best = min(best, (uu + slack) / up)
    return float(np.clip(best, 0.05, 0.99))


def _bin(scores):
    return np.clip((scores + SPAN) * (BINS / (2 * SPAN)), 0, BINS - 1).astype(np.int64)


def contrasting(dp, np_, du, nu):
    """Features whose shares of np_ positives and nu documents differ."""
    pool = (dp + du) / max(1, np_ + nu)
    error = np.sqrt(np.maximum(pool * (1 - pool), 1e-12) * (1 / max(1, np_) + 1 / max(1, nu)))
    return np.flatnonzero((np.abs(dp / max(1, np_) - du / max(1, nu)) / error >= CONTRAST) & (dp + du >= LEAST_DF))


def _listed(live):
    """Documents as lists of live features: doc_id, number of the hash, lists, whether there is any text."""

    def run(batches):
        column = np.full(1 << BITS, -1, np.int32)
        column[live] = np.arange(len(live))
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(2)):
                row, f, dense = features(data, offsets)
                f = column[f]
                row, f = row[f >= 0], f[f >= 0]
                at = np.searchsorted(row, np.arange(hi - lo + 1)) * 4
                cells = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(f.astype(np.int32))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), cells, pa.array(dense > 0)], names=["doc_id", "h", "f", "some"])

    return run


def _rows_of(table):
    cells = table.column("f").to_pylist()
    return _Rows([len(x) // 4 for x in cells], joined(cells, np.int32))


def _fit_group(held, prior):
    """Sums of weights times documents of one group: of a model on each half, or with a prior on the whole."""

    def run(table: pa.Table) -> pa.Table:
        positives, size = held.value
        u, half = _rows_of(table), np.asarray(table.column("h")) % 2
        out = []
        for side in (0, 1) if prior is None else (0,):
            part = u if prior is not None else u.some(half == side)
            if len(part.n):
                w, b = _train(positives, part, size, prior)
                out.append((side, as_bytes(np.append(np.append(w, b), 1) * len(part.n))))
        side, cell = zip(*out)
        return pa.table([pa.array(side, pa.int32()), pa.array(cell, pa.binary())], names=["block", "part"])

    return run


def _averaged(groups: DataFrame, held, prior):
    """{side: weights and bias}: averaged by the numbers of documents."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [as_bytes(sum(np.frombuffer(x, np.float64) for x in sorted(pdf["part"])))]})

    fits = groups.groupBy("group").applyInArrow(trimmed(_fit_group(held, prior)), "block int, part binary")
    total = {r["block"]: np.frombuffer(r["part"], np.float64) for r in fits.groupBy("block").applyInPandas(add, "block int, part binary").collect()}
    return {k: x[:-1] / x[-1] for k, x in total.items()}


def _histogram(held):
    """Scores of every document by the model of the other half, as counts of bins."""

    def run(batches):
        bins = np.zeros(BINS, np.int64)
        for batch in batches:
            u, half = _rows_of(batch), np.asarray(batch.column(1)) % 2
            for side in (0, 1):
                w = held.value.get(1 - side, held.value[side] if side in held.value else None)
                bins += np.bincount(_bin(u.some(half == side).score(w[:-1], w[-1])), minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([as_bytes(bins)], pa.binary())], names=["block", "part"])

    return run


class Classifier:
    """weights of the live features, bias, level; prior as estimated."""

    def __init__(self, weights=None, bias=0.0, level=-np.inf, prior=1.0):
        self.fitted = weights is not None
        self.weights, self.bias, self.level, self.prior = (np.zeros(1) if weights is None else weights), bias, level, prior


def fitted(scratch: Scratch, docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, seed: int = 17):
    """(the model, all documents as lists of its features)."""
    share = scratch.spark.sparkContext.broadcast
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce(F.col("quality"), F.lit(0))).alias("q"), F.max(F.coalesce(F.col("toxic"), F.lit(1))).alias("t"))
    good = _sampled(docs.where("doc_id is not null"), known.where("q = 1 and t = 0"), positives, seed)
    folds = [good[k::3] for k in range(3)]
    df = _summed(docs.select("text").mapInArrow(tidied(_frequencies), "block int, part binary"))
    live = np.zeros(0, np.int64)
    many = 0 if df is None else int(df[:LEVELS].sum())  # each document has one level of symbols
    able = min(map(len, folds)) > 1 and many > 1
    if able:
        live = contrasting(np.bincount(np.concatenate(folds[0]), minlength=1 << BITS), len(folds[0]), df, many)
    column = np.full(1 << BITS, -1)
    column[live] = np.arange(len(live))
    h = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), F.xxhash64("text")), F.lit(1 << 30)).cast("int")
    listed = scratch.write(docs.select("doc_id", h.alias("h"), "text").mapInArrow(tidied(_listed(live)), "doc_id long, h int, f binary, some boolean"), "classifier-features")
    if not able:
        return Classifier(), listed
    groups = listed.where("some").withColumn("group", F.pmod(F.shiftright("h", 1), F.lit(-(-many // GROUP)))).select("group", "h", "f")
    fit, held = (_Rows.of(x, column) for x in folds[1:])
    both = share((fit, len(live)))
    halves = _averaged(groups, both, None)
    scores = np.concatenate([held.score(w[:-1], w[-1]) for w in halves.values()])
    bins = _summed(listed.where("some").select("f", "h").mapInArrow(tidied(_histogram(share(halves))), "block int, part binary"))
    prior = estimate_prior(scores, bins)
    w = _averaged(groups, both, prior)[0]
    return Classifier(w[:-1], w[-1], float(min(0.0, np.quantile(held.score(w[:-1], w[-1]), 1 - KEEP))), prior), listed


def classified(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES) -> DataFrame:
    """(doc_id, score, kept) of every document."""
    with Scratch(workers(docs)) as scratch:
        model, listed = fitted(scratch, docs, labels, positives)
        held = scratch.spark.sparkContext.broadcast(model)

        def run(batches):
            c = held.value
            for batch in batches:
                u, some = _rows_of(batch), np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
                score = u.score(c.weights, c.bias) if c.fitted else np.zeros(len(some))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, mask=~some | (not c.fitted)), pa.array(some & (score >= c.level))], names=["doc_id", "score", "kept"])

        return materialize(listed.select("doc_id", "f", "some").mapInArrow(tidied(run), "doc_id long, score double, kept boolean"), "classified")


def quality_kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) of the documents that stay; see the module for each edge case."""
    return classified(docs, labels).where("kept").select("doc_id", "score")
