"""Toxicity by a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A text is lower-cased and split into words at white space and punctuation. A word's input is the embedding of its
hash beside the element-wise maxima of the embeddings of its character grams of two sizes (with the space before it).
Windows of 96 words, 64 apart, cover every text to its end; two gated recurrent chains read each window in both
directions, attention over the words and one empty step pools their states and inputs, and a logistic unit scores the
window. A document's score is the calibrated score of its highest window.

Training runs on the driver on at most `toxic` + `clean` labelled documents (defaults 1,500 and 2,500, those of the
smallest id hash; one row an id, the least text), whole texts of any length, held-out ids left out; its memory grows
with the sample's characters. The first component of the embeddings is smoothed log odds; while the network is fitted and
calibrated, those of a text come from the other folds' labels alone. Labels are of documents, so training goes in two rounds:
a toxic document is represented by its highest window, by log odds, then by the network; a clean one by its highest and another.

Nulls and edges: a null or wordless text is one empty window and gets a score like any other; labels that are null or
not 0 or 1, or of a null id, don't count; without labels of both kinds all scores are alike, below 1e-17 or, if all are
toxic, near 1; repeated rows give repeated results; a doc_id of any type is hashed as text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import picked, slices

WINDOW, STRIDE = 96, 64
#: Sizes of character grams in bytes, the space before a word included.
GRAMS = (6, 9)
WORD_BITS, GRAM_BITS, WORD_DIM, GRAM_DIM, HIDDEN = 16, 18, 4, 4, 8
#: Where the components of the word's and each gram size's embeddings lie in a word's input.
PARTS = [slice(0, WORD_DIM), *(slice(WORD_DIM + i * GRAM_DIM, WORD_DIM + (i + 1) * GRAM_DIM) for i in range(len(GRAMS)))]
INPUT = PARTS[-1].stop
FIRST = [p.start for p in PARTS]
TOXIC, CLEAN = 1_500, 2_500
#: Documents' worth of evidence that log odds are shrunk by: copies of one document shouldn't make its words telling.
SHRINK = 5
#: Documents in which a word or gram must occur to be learned; rarer ones stay at zero, as unknown ones are.
LEAST = 5
#: Folds of the labelled texts; step of the embeddings against that of the other parameters.
FOLDS, EMBED = 5, 0.5
#: Log odds are cut to this range; a window's first estimate is the sum of its MOST highest.
ODDS, MOST = (-1, 7), 4
#: Bytes of text handled at once.
CHUNK = 1 << 19
_MARKS = bytes(b if chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(256))
_POWERS = np.array([pow(0x9E3779B1, i + 1, 1 << 32) for i in range(64)], dtype=np.uint32)


def mixed(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return ((h ^ (h >> np.uint32(13))) * np.uint32(0x297A2D39) >> np.uint32(32 - bits)).astype(np.int32)


class Words:
    """The words of some texts: their hashes, those of their grams, and where each text's words lie.

    `grams` has a pair for each gram size: the hashes of all words' grams, and where each word's begin. A word too short
    for a gram of a size has the gram 0, which stands for nothing.
    """

    def __init__(self, texts: list[str | None]):
        parts = [(t or "").lower().encode("utf-8", "surrogatepass").translate(_MARKS) for t in texts]
        raw = np.frombuffer(b" " + b" ".join(parts) + b" " * max(GRAMS), dtype=np.uint8)
        solid = raw != 0x20
        starts = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
        lengths = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1 - starts
        at = np.cumsum([0] + [len(p) + 1 for p in parts])
        self.first = np.searchsorted(starts, at + 1)  # first word of each text, and the end
        b = raw.astype(np.uint32)
        self.word, self.grams = np.zeros(0, np.int32), [(np.zeros(0, np.int32), np.zeros(1, np.int64)) for _ in GRAMS]
        if not len(starts):
            return
        place = np.arange(len(raw)) - np.repeat(np.append(0, starts), np.diff(np.concatenate(([0], starts, [len(raw)]))))
        h = np.where(solid, (b + np.uint32(1)) * _POWERS[place & 63], np.uint32(0))
        self.word = mixed(np.add.reduceat(h, starts, dtype=np.uint32), WORD_BITS)
        self.grams = [self._grams(b, starts, lengths, size) for size in GRAMS]

    @staticmethod
    def _grams(b: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        g = np.zeros(len(b) - size, dtype=np.uint32)
        for i in range(size):
            g = g * np.uint32(0x01000193) + b[i : len(b) - size + i]
        count = np.maximum(1, lengths + 2 - size)
        first = np.concatenate(([0], np.cumsum(count)))
        spots = np.repeat(starts - 1, count) + (np.arange(first[-1]) - np.repeat(first[:-1], count))
        return np.where(np.repeat(lengths + 1 < size, count), 0, np.maximum(1, mixed(g[spots], GRAM_BITS))), first

    @classmethod
    def of(cls, texts: list[str]) -> Words:
        """The same for many texts, read in runs of about CHUNK characters: building takes many times a run's size."""
        parts = [cls(texts[i:j]) for i, j in runs(texts)] or [cls([])]
        out = cls([])
        out.word, out.first = np.concatenate([p.word for p in parts]), joined([p.first for p in parts])
        out.grams = [(np.concatenate([p.grams[k][0] for p in parts]), joined([p.grams[k][1] for p in parts])) for k in range(len(GRAMS))]
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, words) of each window; every text has one at least, and all its words are in one."""
        n = np.diff(self.first)
        k = np.maximum(1, -(-np.maximum(0, n - WINDOW) // STRIDE) + 1)
        text = np.repeat(np.arange(len(n)), k)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(k) - k, k)
        start = self.first[:-1][text] + nth * STRIDE
        return text, start, np.minimum(WINDOW, self.first[1:][text] - start)


def runs(texts: list[str | None]):
    """(begin, end) of runs of texts of about CHUNK characters; a longer text is a run of its own."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= CHUNK):
            size += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def joined(firsts: list[np.ndarray]) -> np.ndarray:
    """Places in consecutive parts, each from 0 to its size, as places in the whole."""
    at = np.cumsum([0, *(f[-1] for f in firsts)])
    return np.concatenate([[0], *(f[1:] + a for f, a in zip(firsts, at))]).astype(np.int64)


def both_ways(forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """(steps, 2, windows, width) from two of (windows, steps, width), the second with its steps turned."""
    return np.stack([forward.transpose(1, 0, 2), backward.transpose(1, 0, 2)[::-1]], axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Parameters and passes of the network."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        n = lambda s, *shape: r.normal(0, s, shape).astype(np.float32)
        #: Embeddings of words, then of grams of each size.
        self.tables = [n(0.05, 1 << WORD_BITS, WORD_DIM), *(n(0.05, 1 << GRAM_BITS, GRAM_DIM) for _ in GRAMS)]
        #: Attention (a, ab, v over states, vx over inputs, e0 of the empty step), then the output (o, c).
        self.p = {
            "a": n(0.3, 2 * HIDDEN, HIDDEN), "ab": np.zeros(HIDDEN, np.float32), "v": n(0.3, HIDDEN), "vx": np.zeros(INPUT, np.float32),
            "e0": np.full(1, np.log(2 * WINDOW), np.float32), "o": n(0.3, 2 * HIDDEN + INPUT), "c": np.zeros(1, np.float32),
        }
        for d in "fb":
            self.p |= {f"w{d}": n(0.3, INPUT, 3 * HIDDEN), f"u{d}": n(0.3, HIDDEN, 3 * HIDDEN), f"i{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p["vx"][FIRST] = 0.5
        self.p["o"][[2 * HIDDEN + i for i in FIRST]] = 0.5
        self.scale = (1.0, 0.0)

    def inputs(self, words: Words) -> np.ndarray:
        """One row a word, and a row of zeros at the end."""
        x = np.zeros((len(words.word) + 1, INPUT), np.float32)
        if len(words.word):
            x[:-1, PARTS[0]] = self.tables[0][words.word]
            for table, part, (ids, first) in zip(self.tables[1:], PARTS[1:], words.grams):
                for d in range(GRAM_DIM):
                    x[:-1, part.start + d] = np.maximum.reduceat(table[ids, d], first[:-1])
        return x

    def chains(self, x, mask, keep: bool):
        """States of both directions, (windows, steps, 2 * HIDDEN), from (windows, steps, inputs); the backward chain is run
        beside the forward one, over turned steps."""
        p, H, steps = self.p, HIDDEN, mask.shape[1]
        gates = np.empty((steps, 2, len(x), 3 * H), np.float32)
        gates[:, 0] = (x @ p["wf"] + p["if"]).transpose(1, 0, 2)
        gates[:, 1] = (x @ p["wb"] + p["ib"]).transpose(1, 0, 2)[::-1]
        m, u = both_ways(mask[:, :, None], mask[:, :, None]), np.stack([p["uf"], p["ub"]])
        h, out, kept = np.zeros((2, len(x), H), np.float32), np.empty((steps, 2, len(x), H), np.float32), []
        for t in range(steps):
            hu = h @ u
            zr = sigmoid(gates[t, :, :, : 2 * H] + hu[..., : 2 * H])
            z, r = zr[..., :H], zr[..., H:]
            n = np.tanh(gates[t, :, :, 2 * H :] + r * hu[..., 2 * H :])
            if keep:
                kept.append((h, z, r, n, hu[..., 2 * H :], m[t]))
            h = out[t] = h + m[t] * (1 - z) * (n - h)
        return np.concatenate([out[:, 0], out[::-1, 1]], axis=2).transpose(1, 0, 2), kept

    def forward(self, x, mask, keep: bool = False):
        s, kept = self.chains(x, mask, keep)
        q = np.tanh(s @ self.p["a"] + self.p["ab"])
        # Beside the words stands an empty step that attention may rest on: so its mass on telling words counts them.
        e = q @ self.p["v"] + x @ self.p["vx"] + (mask - 1) * 1e4
        top = np.maximum(e.max(axis=1, keepdims=True), self.p["e0"])
        e = np.exp(e - top)
        al = e / (e.sum(axis=1, keepdims=True) + np.exp(self.p["e0"] - top))
        sx = np.concatenate([s, x], axis=2)
        pool = np.einsum("nt,ntd->nd", al, sx)
        return pool @ self.p["o"] + self.p["c"][0], (kept, s, q, al, sx, pool)

    def gradients(self, x, mask, y, weight):
        """Gradients of the weighted cross entropy for the parameters and the inputs."""
        logit, (kept, s, q, al, sx, pool) = self.forward(x, mask, True)
        p, H = self.p, HIDDEN
        d = (weight * (sigmoid(logit) - y) / len(y)).astype(np.float32)
        g = {"o": pool.T @ d, "c": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * p["o"]
        dal = np.einsum("nd,ntd->nt", dpool, sx)
        dsx = al[:, :, None] * dpool[:, None, :]
        mean = (al * dal).sum(axis=1, keepdims=True)
        de = al * (dal - mean)
        g["e0"] = np.array([((al.sum(axis=1, keepdims=True) - 1) * mean).sum()], np.float32)
        g["v"], g["vx"] = np.einsum("nt,nth->h", de, q), np.einsum("nt,ntd->d", de, x)
        dq = de[:, :, None] * p["v"] * (1 - q * q)
        g["a"], g["ab"] = np.einsum("nts,nth->sh", s, dq), dq.sum(axis=(0, 1))
        ds = dsx[:, :, : 2 * H] + dq @ p["a"].T
        dx = dsx[:, :, 2 * H :] + de[:, :, None] * p["vx"]
        part, u = both_ways(ds[:, :, :H], ds[:, :, H:]), np.stack([p["uf"], p["ub"]])
        du, dgates, dh = np.zeros_like(u), np.zeros((*part.shape[:3], 3 * H), np.float32), np.zeros(part.shape[1:], np.float32)
        for t in range(len(kept) - 1, -1, -1):
            h, z, r, n, hn, m = kept[t]
            dh = dh + part[t]
            dn, dz = dh * m * (1 - z) * (1 - n * n), dh * m * (h - n) * z * (1 - z)
            dr = dn * hn * r * (1 - r)
            dgates[t] = np.concatenate([dz, dr, dn], axis=2)
            dhu = np.concatenate([dz, dr, dn * r], axis=2)
            du += h.transpose(0, 2, 1) @ dhu
            dh = dh * (1 - m * (1 - z)) + dhu @ u.transpose(0, 2, 1)
        for k, i, back in (("f", 0, dgates[:, 0]), ("b", 1, dgates[::-1, 1])):
            back = np.ascontiguousarray(back.transpose(1, 0, 2))
            g[f"u{k}"], g[f"i{k}"] = du[i], back.sum(axis=(0, 1))
            g[f"w{k}"] = x.reshape(-1, x.shape[2]).T @ back.reshape(-1, 3 * H)
            dx += back @ p[f"w{k}"].T
        return g, dx * mask[:, :, None]

    def scores(self, words: Words, odds: np.ndarray | None = None, most: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(text, logit) of every window; with other log odds for the words if they are given."""
        text, start, n = words.windows()
        x = self.inputs(words)
        if odds is not None:
            x[:, FIRST] = odds
        out = np.zeros(len(text), np.float32)
        steps = np.arange(WINDOW)
        for i in range(0, len(text), most):
            inside = steps < n[i : i + most, None]
            at = np.where(inside, start[i : i + most, None] + steps, len(words.word))
            out[i : i + most] = self.forward(x[at], inside.astype(np.float32))[0]
        return text, out


def best_window(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """The index of the highest value of each text; the first of equals."""
    order = np.lexsort((np.arange(len(values)), -values, text))
    return order[np.searchsorted(text[order], np.arange(n))]


def log_odds(net: Network, words: Words, y: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Set the first component of the embeddings to smoothed log odds of the labels.

    Returns which rows of each table are known, and for each word (and a row of zeros) the log odds that the other folds' texts
    give it: a text's own label must not stand in its input.
    """
    of = np.repeat(np.arange(len(y)), np.diff(words.first))
    fold, known, out = np.arange(len(y)) % FOLDS, [], np.zeros((len(of) + 1, len(net.tables)), np.float32)
    for i, table in enumerate(net.tables):
        ids, first = (words.word, np.arange(len(of) + 1)) if i == 0 else words.grams[i - 1]
        rows, owner = len(table), np.repeat(of, np.diff(first))
        pairs = np.unique(owner * rows + ids.astype(np.int64))
        text, row = pairs // rows, pairs % rows
        count = np.bincount((y[text] * FOLDS + fold[text]) * rows + row, minlength=2 * FOLDS * rows).reshape(2, FOLDS, rows)
        known.append((count.sum(axis=(0, 1)) >= LEAST) & ((np.arange(rows) > 0) | (i == 0)))

        def odds(seen: np.ndarray, texts: np.ndarray, known: np.ndarray = known[-1]) -> np.ndarray:
            raw = np.log((seen[1] + 0.1) / (texts[1] + 1)) - np.log((seen[0] + 0.5) / (texts[0] + 1))
            return np.where(known, np.clip(raw, *ODDS) * seen.sum(axis=0) / (seen.sum(axis=0) + SHRINK), 0)

        texts = np.bincount(y * FOLDS + fold, minlength=2 * FOLDS).reshape(2, FOLDS)
        table[~known[-1]] = 0
        table[:, 0] = odds(count.sum(axis=1), texts.sum(axis=1))
        others = np.stack([odds(count.sum(axis=1) - count[:, k], texts.sum(axis=1) - texts[:, k]) for k in range(FOLDS)])
        if len(of):
            out[:-1, i] = np.maximum.reduceat(others[fold[owner], ids], first[:-1])
    return known, out


def fitted(words: Words, y: np.ndarray, seed: int, epochs: int, batch: int, rate: float) -> Network:
    """The network fitted to the words of labelled texts, and calibrated."""
    net, r = Network(seed), np.random.default_rng(seed)
    known, odds = log_odds(net, words, y)
    text, start, n = words.windows()
    steps = np.arange(WINDOW)
    inside = steps < n[:, None]
    spots = np.where(inside, start[:, None] + steps, len(words.word))
    high = np.sort(np.where(inside, odds.max(axis=1)[spots], 0), axis=1)[:, -MOST:].sum(axis=1)
    m, v, t = {}, {}, 0
    for round_ in range(2):
        top = best_window(high, text, len(y))
        other = r.integers(0, len(text), 2 * len(y))
        chosen = np.unique(np.concatenate([top, other[y[text[other]] == 0]]))
        label = y[text[chosen]].astype(np.float32)
        weight = np.where(label == 1, 0.5 / max(label.mean(), 1e-3), 0.5 / max(1 - label.mean(), 1e-3)).astype(np.float32)
        for e in range(epochs):
            for b in np.array_split(r.permutation(len(chosen)), max(1, len(chosen) // batch)):
                c, t = chosen[b], t + 1
                at, mask = spots[c], inside[c].astype(np.float32)
                # Only the words of the batch are embedded anew.
                used, where = np.unique(at, return_inverse=True)
                used = used[used < len(words.word)]
                where = np.minimum(where.reshape(at.shape), len(used))
                x, sources = embed(net, words, used)
                x[:, FIRST] = odds[used]
                g, dx = net.gradients(np.vstack([x, np.zeros((1, INPUT), np.float32)])[where], mask, label[b], weight[b])
                for k in g:
                    m[k], v[k] = 0.9 * m.get(k, 0) + 0.1 * g[k], 0.99 * v.get(k, 0) + 0.01 * g[k] ** 2
                    net.p[k] = (net.p[k] - rate / (1 + round_) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
                back = np.zeros((len(used) + 1, INPUT), np.float32)
                np.add.at(back, where.reshape(-1), dx.reshape(-1, INPUT))
                for table, ok, part, ids in zip(net.tables, known, PARTS, sources):
                    for d in range(1, table.shape[1]):
                        np.add.at(table[:, d], ids[:, d], -EMBED * rate * back[:-1, part.start + d] * ok[ids[:, d]])
        text, high = net.scores(words, odds)
    net.scale = platt(high[best_window(high, text, len(y))].astype(float), y)
    return net


def train(texts: list[str], y: np.ndarray, seed: int = 3, epochs: int = 8, batch: int = 256, rate: float = 0.02) -> Network:
    """The network fitted to labelled texts, as the module says."""
    if not len(y) or y.min() == y.max():
        net = Network(seed)
        net.scale = (0.0, -40.0 if not len(y) or y.max() == 0 else 40.0)
        return net
    return fitted(Words.of(texts), y, seed, epochs, batch, rate)


def embed(net: Network, words: Words, used: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Inputs of some words, and for each table the row that each component came from."""
    x, sources = np.zeros((len(used), INPUT), np.float32), [np.repeat(words.word[used][:, None], WORD_DIM, axis=1)]
    x[:, PARTS[0]] = net.tables[0][words.word[used]]
    for table, part, (ids, first) in zip(net.tables[1:], PARTS[1:], words.grams):
        source = np.zeros((len(used), GRAM_DIM), np.int64)
        if len(used):
            count = first[used + 1] - first[used]
            begin = np.cumsum(count) - count
            grams = ids[np.repeat(first[used] - begin, count) + np.arange(count.sum())]
            owner = np.repeat(np.arange(len(used)), count)
            for d in range(GRAM_DIM):
                val = table[grams, d]
                x[:, part.start + d] = best = np.maximum.reduceat(val, begin)
                hit = np.flatnonzero(val == best[owner])
                source[owner[hit][::-1], d] = grams[hit][::-1]  # the first of equals
        sources.append(source)
    return x, sources


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps on the unweighted labels; the slope is never below zero."""
    a, b = 1.0, 0.0
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = q * (1 - q) + 1e-9
        grad = np.array([((q - y) * z).sum() + 0.1 * (a - 1), (q - y).sum() + 0.1 * b])
        hess = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(hess, grad), -0.5, 0.5)
        a = max(a, 1e-3)
    return float(a), float(b)


def document_scores(texts: list[str | None], net: Network) -> list[float]:
    """The calibrated score of each text's highest window; texts are handled in runs of about CHUNK bytes."""
    out: list[np.ndarray] = []
    for i, j in runs(texts):
        text, logit = net.scores(Words(texts[i:j]))
        top = np.full(j - i, -np.inf)
        np.maximum.at(top, text, logit)
        out.append(1 / (1 + np.exp(-np.clip(net.scale[0] * top + net.scale[1], -40, 40))))
    return np.concatenate(out).tolist() if out else []


def held_out(doc_id):
    """Whether a document is kept from training: crc32 of its id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> Network:
    """The network for labels (doc_id, toxic); ids of the sample, bounded by its two limits, are broadcast."""
    known = picked(labels, "doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("order", F.xxhash64("doc_id"))
    ids = [known.where(f"toxic = {c}").orderBy("order", "doc_id").limit(n) for c, n in ((1, toxic), (0, clean))]
    sample = ids[0].unionByName(ids[1])  # at most toxic + clean rows: broadcast, so that texts stay where they are
    whole = picked(docs, "doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id")
    one = whole.groupBy("order", "doc_id", "toxic").agg(F.min("text").alias("text"))  # repeated ids don't swell the sample
    rows = sorted(one.select("order", "doc_id", "text", "toxic").collect())
    return train([r["text"] for r in rows], np.array([r["toxic"] for r in rows], dtype=np.int64))


def toxicity(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document."""
    rows = picked(docs, "doc_id", "text")
    net = fit(docs, labels, toxic, clean)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # parameters of fixed size, 9 MB
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in slices(batches):
            s = pa.array(document_scores(b.column(1).to_pylist(), shared.value), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), s], names=["doc_id", "score"])

    out = rows.mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
