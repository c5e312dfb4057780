"""Personal data and secrets by a character-level bidirectional LSTM with CRF transitions.

The network is trained here, in numpy, on labelled spans: windows of corpus text without digits and
without "@" into which generated personal data (and harmless numbers, labelled as nothing) are put at
known places. All of every text is run through it, in windows of WINDOW characters that overlap by
WINDOW - STRIDE. The emission scores of the windows are blended, each counting most at its centre, and one
Viterbi decoding over the whole text reconciles them. To be quick that decoding is done in stretches: unlabelled()
proves where the best path of the whole text has no label, and only what lies between such places is decoded.

The gates are piecewise linear and the cell's squashing is x / (1 + |x|), which vector units do quickly.

Defined results: null and empty texts have no spans. Places are counted in characters from 0. Spans of a
document never overlap; a label's tags are all of one kind, so what touches is one span. Ties go to the tag first
in TAGS. Repeated rows give the same spans again; rows with a null doc_id are searched too. Other columns do not
matter. Texts of any length are searched whole. Without any training text, as for empty tables, the contexts are
blanks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import tidied, workers

KINDS = ["EMAIL", "PHONE", "IP", "CARD", "SECRET", "SSN", "IBAN"]
TAGS = 1 + len(KINDS)
WINDOW, STRIDE = 512, 464
EMBED, HIDDEN = 16, 16
CONTEXT_DOCS, LENGTH, TRAIN_WINDOWS, BATCH, STEPS = 400, 128, 8000, 72, 600  # bounds of the training sample and of the fit
ROWS = 1024  # windows run at once
CHARS = 1_000_000  # of texts searched at once
PAD, OTHER_LETTER, OTHER = 0, 1, 2

_ASCII = np.full(128, OTHER)
_ASCII[[9, 10, 13]] = 3
_ASCII[32:127] = np.arange(4, 99)
CLASSES = 99


def char_classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    low = code < 128
    out = np.full(len(code), OTHER_LETTER)
    out[low] = _ASCII[code[low]]
    return out


class Tagger:
    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        h = HIDDEN
        init = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": init(CLASSES, EMBED) * 3, "Wo": init(2 * h, TAGS), "bo": np.zeros(TAGS, np.float32), "T": np.zeros((TAGS, TAGS), np.float32), "S": np.zeros(TAGS, np.float32)}
        slope = np.repeat([0.25, 1], [3 * h, h]).astype(np.float32)
        for d in "fb":
            self.p |= {f"Wx{d}": init(EMBED, 4 * h) * slope, f"Wh{d}": init(h, 4 * h) * slope, f"b{d}": np.repeat([0.5, 0.75, 0.5, 0], h).astype(np.float32)}

    def _run(self, x, d, keep=None, scores=None):
        """Hidden states (time, row, HIDDEN) of one direction over x (time, row), and with keep what _back needs. With
        scores, what each step adds to the emissions is added there, and no states are held."""
        p, h = self.p, HIDDEN
        table = (p["E"] @ p[f"Wx{d}"] + p[f"b{d}"]).reshape(CLASSES, 4, h).transpose(1, 0, 2).copy()
        wh, n, kind = p[f"Wh{d}"].reshape(h, 4, h).transpose(1, 0, 2).copy(), x.shape[1], table.dtype
        wo = p["Wo"][:h] if d == "f" else p["Wo"][h:]
        hs, c = np.zeros((1 if keep is None else len(x) + 1, n, h), kind), np.zeros((n, h), kind)
        z, add, more = np.empty((4, n, h), kind), np.empty((4, n, h), kind), np.empty((n, h), kind)
        gate, (i, f, o, g) = z[:3], z
        for t in range(len(x)):
            at = 0 if keep is None else t
            np.take(table, x[t], axis=1, out=z, mode="clip")
            np.matmul(hs[at], wh, out=add)
            z += add
            if keep is not None:
                live, before = (gate > 0) & (gate < 1), c.copy()
            np.clip(gate, 0, 1, out=gate)
            np.abs(g, out=more)
            more += 1
            g /= more
            c *= f
            np.multiply(i, g, out=add[0])
            c += add[0]
            np.abs(c, out=more)
            more += 1
            np.divide(c, more, out=more)
            np.multiply(o, more, out=hs[at if keep is None else t + 1])
            if keep is not None:
                keep.append((np.concatenate([i, f, o], 1), g.copy(), before, more.copy(), np.concatenate(live, 1)))
            if scores is not None:
                scores[t] += hs[0] @ wo
        return hs

    def emissions(self, x):
        em = np.empty((*x.shape, TAGS), self.p["bo"].dtype)
        em[:] = self.p["bo"]
        self._run(x, "f", scores=em)
        self._run(x[::-1], "b", scores=em[::-1])
        return em

    def _kept(self, x):
        sf, sb = [], []
        f, b = self._run(x, "f", sf), self._run(x[::-1], "b", sb)
        both = np.concatenate([f[1:], b[:0:-1]], 2)
        return both @ self.p["Wo"] + self.p["bo"], both, (f, sf), (b, sb)

    def _back(self, x, d, hs, saved, dh_out, grad):
        p, h = self.p, HIDDEN
        wh = p[f"Wh{d}"]
        dh, dc = np.zeros_like(hs[0]), np.zeros_like(hs[0])
        dtable = np.zeros((CLASSES, 4 * h), hs.dtype)
        for t in range(len(x) - 1, -1, -1):
            gate, g, before, tc, live = saved[t]
            i, f, o = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :]
            dh = dh + dh_out[t]
            dc = dc + dh * o * (1 - np.abs(tc)) ** 2
            dz = np.concatenate([np.concatenate([dc * g, dc * before, dh * tc], 1) * live, dc * i * (1 - np.abs(g)) ** 2], 1)
            grad[f"Wh{d}"] += hs[t].T @ dz
            here = np.zeros((CLASSES, len(dz)), dz.dtype)
            here[x[t], np.arange(len(dz))] = 1
            dtable += here @ dz
            dh, dc = dz @ wh.T, dc * f
        grad[f"b{d}"] += dtable.sum(0)
        grad[f"Wx{d}"] += p["E"].T @ dtable
        grad["E"] += dtable @ p[f"Wx{d}"].T

    def loss_and_grad(self, x, y):
        """Negative log likelihood per window and its gradient. x, y: (time, row)."""
        p, (steps, n) = self.p, x.shape
        em, both, (f, sf), (b, sb) = self._kept(x)
        et, rows = np.exp(p["T"]), np.arange(n)
        alpha, scale = np.empty_like(em), np.empty((steps, n), em.dtype)
        for t in range(steps):
            a = p["S"] + em[t] if t == 0 else np.log(alpha[t - 1] @ et + 1e-30) + em[t]
            m = a.max(1, keepdims=True)
            s = m[:, 0] + np.log(np.exp(a - m).sum(1))
            alpha[t], scale[t] = np.exp(a - s[:, None]), s
        beta = np.ones((n, TAGS), em.dtype)
        post, pair = np.empty_like(em), np.zeros((TAGS, TAGS), em.dtype)
        for t in range(steps - 1, -1, -1):
            q = alpha[t] * beta
            post[t] = q / q.sum(1, keepdims=True)
            if t:
                e = np.exp(em[t] - scale[t][:, None]) * beta
                u = alpha[t - 1][:, :, None] * et[None] * e[:, None, :]
                pair += (u / u.sum((1, 2), keepdims=True)).sum(0)
                beta = e @ et.T
                beta /= beta.max(1, keepdims=True)
        gold = p["S"][y[0]].sum() + sum(em[t, rows, y[t]].sum() for t in range(steps)) + p["T"][y[:-1], y[1:]].sum()
        dem = post
        for t in range(steps):
            dem[t, rows, y[t]] -= 1
        dem /= n
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        grad["S"] = dem[0].sum(0)
        seen = np.zeros((TAGS, TAGS), np.float32)
        np.add.at(seen, (y[:-1], y[1:]), 1)
        grad["T"] = (pair - seen) / n
        grad["Wo"] = np.einsum("tnh,tnk->hk", both, dem, optimize=True)
        grad["bo"] = dem.sum((0, 1))
        dboth = dem @ p["Wo"].T
        self._back(x, "f", f, sf, dboth[:, :, :HIDDEN], grad)
        self._back(x[::-1], "b", b, sb, dboth[::-1, :, HIDDEN:], grad)
        return float((scale.sum() - gold) / n), grad

    def fit(self, x, y, steps: int = STEPS, rate: float = 0.012, seed: int = 5):
        """Adam on random batches of windows. x, y: (window, time)."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for t in range(1, steps + 1):
            pick = r.integers(0, len(x), BATCH)
            loss, grad = self.loss_and_grad(x[pick].T, y[pick].T)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            lr = rate * min(1.0, 1.6 * (1 - t / (steps + 1)))
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return loss

    def viterbi(self, em, first=None, last=None):
        """Best tags of one stretch (time, TAGS); first and last are the tags before and behind it, if any."""
        return self.decode([em], [first is None], [last is None], first or 0, last or 0)[0]

    def decode(self, ems, opens, ends, first=0, last=0):
        """Best tags of many stretches at once, the longest first in each step. opens, ends: whether a stretch begins or
        ends its text; else the tag before it is first and the one behind it last."""
        trans, size = self.p["T"], np.array([len(e) for e in ems], np.int64)
        order = np.argsort(-size, kind="stable")
        many = len(ems)
        grid = np.zeros((int(size.max()), many, TAGS), trans.dtype)
        for k, at in enumerate(order):
            grid[: size[at], k] = ems[at]
        score = grid[0] + np.where(np.array(opens)[order][:, None], self.p["S"], trans[first])
        back = np.zeros(grid.shape, np.int8)
        live = np.searchsorted(-size[order], -np.arange(1, len(grid) + 1), "right")
        for t in range(1, len(grid)):
            n = live[t]
            to = score[:n, :, None] + trans
            back[t, :n] = to.argmax(1)
            score[:n] = to.max(1) + grid[t, :n]
        tag = np.where(np.array(ends)[order][:, None], score, score + trans[:, last]).argmax(1)
        tags = np.zeros(grid.shape[:2], np.int8)
        rows = np.arange(many)
        for t in range(len(grid) - 1, -1, -1):
            n = live[t]
            tags[t, :n] = tag[:n]
            tag[:n] = back[t, rows[:n], tag[:n]] if t else tag[:n]
        out: list = [None] * many
        for k, at in enumerate(order):
            out[at] = tags[: size[at], k]
        return out

    def unlabelled(self, em):
        """Places where the best path over em surely has tag 0. Let gain be what a place's tag 0 is ahead of its other
        tags, less what a transition between others can be ahead of 0 to 0. A path that has no 0 in a run of places of
        gains above `least` would be better with 0 in all of it, if the gains add up to more than entering and leaving
        the run can cost; and two places of tag 0 in such a run have only 0 between them. So a place of a run with
        enough gain before it and enough behind it has tag 0."""
        t, s = self.p["T"].astype(np.float64), self.p["S"].astype(np.float64)
        inner = max(0.0, (t[1:, 1:] - t[0, 0]).max())
        cost = max((t[:, 1:] - t[:, :1]).max(), (s[1:] - s[0]).max(), 0) + max((t[1:] - t[:1]).max(), 0)
        least = max(0.0, (t[0, 1:] - t[0, 0]).max()) + max(0.0, (t[1:, 0] - t[0, 0]).max()) + 1e-3
        best = em[:, 1]
        for k in range(2, TAGS):
            best = np.maximum(best, em[:, k])
        gain = (em[:, 0] - best).astype(np.float64) - inner
        good = gain > least
        total = np.append(0, np.cumsum(np.where(good, gain, 0)))
        at = np.arange(len(em))
        begin = np.maximum.accumulate(np.where(good, -1, at)) + 1
        end = np.minimum.accumulate(np.where(good, len(em), at)[::-1])[::-1]
        return good & (total[at] - total[np.minimum(begin, at)] > cost + 1e-3) & (total[np.maximum(end, at + 1)] - total[at + 1] > cost + 1e-3)


def _iban(r, digits):
    country = ("DE", "FR", "ES", "NL", "GB", "IT", "CH")[r.integers(7)]
    s = country + digits(2) + ("".join("ABCDEFGHKLMNPRSTUWXYZ"[i] for i in r.integers(0, 21, 4)) if country in ("NL", "GB") else "") + digits(r.integers(12, 21))
    return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if r.random() < 0.5 else s


def _secret(r, word, hexa):
    """(text, whether only the words before it tell that it is one)."""
    of = lambda n, signs: "".join(signs[i] for i in r.integers(0, len(signs), n))
    upper, base = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    k = r.integers(0, 12)
    if k < 6:
        return (hexa(40), hexa(32), hexa(64), "sk-" + hexa(40), hexa(40), hexa(r.integers(24, 65)))[k], False
    if k < 7:
        return "AKIA" + of(16, upper), False
    if k < 9:
        return of(r.integers(20, 61), base) + ("", "=", "==")[r.integers(3)], False
    if k < 10:
        return ("ghp_", "xoxb-", "sk_live_", "glpat-")[r.integers(4)] + of(r.integers(20, 40), base[:62]), False
    if k < 11:
        return ("", "-", "_")[r.integers(3)].join(word() for _ in range(r.integers(2, 5))) + ("", of(2, "0123456789"), "!")[r.integers(3)], True
    return of(r.integers(8, 17), base[:62] + "!#$%&*?"), True


def _generated(r, words):
    """(text, kind or None, whether it needs a name before it) of one made-up thing."""
    digits = lambda n: "".join(map(str, r.integers(0, 10, n)))
    hexa = lambda n: "".join("0123456789abcdef"[i] for i in r.integers(0, 16, n))
    word = lambda: "".join(c for c in words[r.integers(len(words))] if c.isalpha() and c.isascii()).lower() or "the"
    one = lambda *x: x[r.integers(len(x))]
    k = r.integers(0, 20)
    if k < 3:
        local = word() + one("", ".", "_", "-", "+") + one(digits(r.integers(1, 4)), word(), word()[:1])
        return f"{local}@{one('mail', 'web', '', word() + '-')}{one(word(), digits(1), word() + '.' + word())}.{one('example.com', 'com', 'org', 'net', 'de', 'io', 'co.uk', 'co.jp', 'ac.at', word()[:5] + '.fr')}", 0, False
    if k < 6:
        a, b, c = digits(3), digits(3), digits(4)
        return one(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)} {a} {b} {c}", f"+1 ({a}) {b}-{c}", f"{a}.{b}.{c}", f"0{digits(2)}/{digits(r.integers(6, 9))}", f"+{digits(2)} {digits(2)} {digits(8)}", f"0{digits(4)} {digits(6)}", f"1-800-{b}-{c}"), 1, False
    if k < 7:
        return ".".join(str(i) for i in r.integers(0, 256, 4)), 2, False
    if k < 8:
        return one(".".join(str(i) for i in (one(10, 127, 192, 172), *r.integers(0, 30, 3))), ":".join(hexa(r.integers(1, 5)) for _ in range(8)), ":".join(hexa(4) for _ in range(r.integers(1, 5))) + "::" + ":".join(hexa(r.integers(1, 5)) for _ in range(r.integers(1, 3)))), 2, False
    if k < 10:
        s = "3456"[r.integers(4)] + digits(15)
        return one(s, s, " ".join(s[i : i + 4] for i in (0, 4, 8, 12)), "-".join(s[i : i + 4] for i in (0, 4, 8, 12)), f"37{digits(13)}"), 3, False
    if k < 13:
        return (lambda x: (x[0], 4, x[1]))(_secret(r, word, hexa))
    if k < 14:
        return f"{digits(3)}-{digits(2)}-{digits(4)}", 5, False
    if k < 15:
        return _iban(r, digits), 6, False
    return one(str(r.integers(0, 100)), str(r.integers(1900, 2031)), f"{r.integers(1, 32)}.{r.integers(1, 13)}.{r.integers(1990, 2031)}", f"{r.integers(1990, 2031)}-{r.integers(1, 13):02d}-{r.integers(1, 29):02d}", f"{r.integers(1, 1000)},{digits(3)}", f"v{r.integers(0, 9)}.{r.integers(0, 20)}", f"{word()}{digits(2)}", f"{r.integers(0, 1000)}.{digits(2)}", f"{r.integers(0, 24)}:{digits(2)}", f"{digits(5)}", f"{word()}.{word()}", f"@{word()}", f"{word()}_{word()}", f"{r.integers(1, 100)}%", "".join(word() for _ in range(3)), word().upper()), None, False


def training_windows(texts: list[str], count: int = TRAIN_WINDOWS, seed: int = 3):
    """(classes, tags), both (window, time), with spans at known places; a fifth of the windows is plain text."""
    r = np.random.default_rng(seed)
    texts = [t for t in texts if t and not any(c.isdigit() or c == "@" for c in t)] or [" "]
    x, y = np.zeros((count, LENGTH), np.int64), np.zeros((count, LENGTH), np.int64)
    for row in range(count):
        text = texts[r.integers(len(texts))]
        words = text.split() or ["the"]
        at = r.integers(0, len(text))
        plain = r.random() < 0.2
        out = text[at : at + (LENGTH if plain else r.integers(0, 110))]
        tags = [0] * len(out)
        upper = r.random() < 0.1
        for _ in range(0 if plain else r.integers(1, 4)):
            made, kind, named = _generated(r, words)
            if upper:
                made = made.upper()
            lead = "" if not out or r.random() < 0.05 else ("\n", " (", ": ", " ", " ", " ", " ", " ", " ", " ")[r.integers(10)]
            if kind == 4 and (named or r.random() < 0.7):
                lead += ("token = ", "key: ", "secret=", "password = ", "api_key=", "token = ", "password: ", "passwd=", "pwd: ", "secret key: ", "Authorization: Bearer ")[r.integers(11)]
            quote = '"' if kind == 4 and r.random() < 0.5 else ""
            tail = quote + ("", "", "", ".", ",", ", ", "###", "!!", "$$$", "%%%", "&&&", ".\n", ")", " |", ";", "?", ":")[r.integers(17)]
            at = r.integers(0, len(text))
            more = "" if r.random() < 0.25 else " " + text[at : at + r.integers(0, 60)]
            own = [0 if kind is None else 1 + kind] * len(made)
            out += lead + quote + made + tail + more
            tags += [0] * (len(lead) + len(quote)) + own + [0] * (len(tail) + len(more))
        cut = r.integers(0, max(1, len(out) - LENGTH + 1)) if r.random() < 0.9 else 0
        code = char_classes(out.upper() if upper and len(out.upper()) == len(out) else out)[cut : cut + LENGTH]
        x[row, : len(code)], y[row, : len(code)] = code, tags[cut : cut + LENGTH]
    return x, y


def context_sample(docs: DataFrame, most: int = CONTEXT_DOCS, seed: int = 13) -> list[str]:
    """Texts of the smallest doc_id hash, `most` of them, without digits and "@"."""
    ids = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(2 * most)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(~F.col("text").rlike("[0-9@]")).join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "text").select("text").limit(most).collect()
    return [r["text"] for r in rows]


def fit_tagger(texts: list[str], steps: int = STEPS) -> Tagger:
    """The tagger for these contexts."""
    tagger = Tagger()
    tagger.fit(*training_windows(texts), steps)
    return tagger


_WEIGHT = (1.0 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])).astype(np.float32)


def blended(tagger: Tagger, codes: list[np.ndarray]):
    """Emission scores (time, TAGS) of every text, from windows that overlap."""
    pieces = [(k, w, min(WINDOW, len(code) - w)) for k, code in enumerate(codes) for w in range(0, max(1, len(code) - (WINDOW - STRIDE)), STRIDE)]
    pieces.sort(key=lambda p: -p[2])
    total = [np.zeros((len(code), TAGS), np.float32) for code in codes]
    weight = [np.zeros((len(code), 1), np.float32) for code in codes]
    for at in range(0, len(pieces), ROWS):
        part = pieces[at : at + ROWS]
        x = np.zeros((part[0][2], len(part)), np.int64)
        for j, (k, w, n) in enumerate(part):
            x[:n, j] = codes[k][w : w + n]
        em = tagger.emissions(x)
        for j, (k, w, n) in enumerate(part):
            total[k][w : w + n] += em[:n, j] * _WEIGHT[:n, None]
            weight[k][w : w + n] += _WEIGHT[:n, None]
    for em, w in zip(total, weight):
        em /= w
    return total


def _tags(tagger: Tagger, ems: list[np.ndarray]):
    """Best tags of every text: (text, first place, tags) of the stretches that may have labels."""
    todo = []
    for k, em in enumerate(ems):
        open_ = ~tagger.unlabelled(em)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], open_, [False]]).astype(np.int8)))
        todo += [(k, int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])]
    todo.sort(key=lambda s: s[2] - s[1])
    for at in range(0, len(todo), ROWS):
        part = todo[at : at + ROWS]
        for (k, a, _), tags in zip(part, tagger.decode([ems[k][a:b] for k, a, b in part], [a == 0 for _, a, _ in part], [b == len(ems[k]) for k, _, b in part])):
            yield k, a, tags


def find_spans(tagger: Tagger, texts: list[str | None]):
    """For each text its spans (start, end, kind)."""
    out: list = [[] for _ in texts]
    full, lo = [k for k, text in enumerate(texts) if text], 0
    while lo < len(full):
        hi, held = lo, 0
        while hi < len(full) and (hi == lo or held + len(texts[full[hi]]) <= CHARS):
            held += len(texts[full[hi]])
            hi += 1
        for k, a, tags in _tags(tagger, blended(tagger, [char_classes(texts[i]) for i in full[lo:hi]])):
            cut = np.append(np.append(0, np.flatnonzero(np.diff(tags)) + 1), len(tags))
            out[full[lo + k]] += [(a + int(p), a + int(q), int(tags[p]) - 1) for p, q in zip(cut, cut[1:]) if tags[p]]
        lo = hi
    return [sorted(spans) for spans in out]


def pii_spans(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """(doc_id, kind, start, end) of every span; see the module for each edge case."""
    held = workers(docs).sparkContext.broadcast(tagger)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = find_spans(held.value, batch.column(1).to_pylist())
            rows = [(d, KINDS[k], a, b) for d, spans in zip(ids, found) for a, b, k in spans]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int32(), pa.int32()))], names=["doc_id", "kind", "start", "end"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, kind string, start int, end int")


def redact(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; n_chars, if there, follows."""
    held = workers(docs).sparkContext.broadcast(tagger)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            hot = batch.column(at).to_pylist()
            for k, (text, spans) in enumerate(zip(hot, find_spans(held.value, hot))):
                for a, b, kind in reversed(spans):
                    text = f"{text[:a]}[{KINDS[kind]}]{text[b:]}"
                hot[k] = text
            yield batch.set_column(at, batch.schema.field(at), pa.array(hot, batch.schema.field(at).type))

    done = docs.mapInArrow(tidied(run), docs.schema)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
