"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as its own embedding (words of the training sample that are common enough) next to the mean of the embeddings
of its character trigrams.  Overlapping windows of 24 words, one from every word, cover a text; a document's score is that of
its worst window.  The network reads a text in tiles of 96 words and what their windows need, with 8 words of context on both
sides: each direction takes one step a word, the windows differ in what attention pools, and a pooled sum over a window is
made of sums over 8 and 16 words.
Training picks, for each toxic document, the window that scores highest so far, and for clean documents their worst ones; it
reads windows with their context too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, labelled_sample, reach_workers, with_ids

SAMPLE = 2500
WINDOW, CONTEXT, TILE = 24, 8, 96
WORD_DIM, CHAR_DIM, HIDDEN = 8, 8, 8
CHAR_ROWS = 8192
_WORD = re.compile(r"[^\W\d_]+")
_KNOWN = 200_000


def words_of(text) -> list[str]:
    return _WORD.findall(text.lower()) if isinstance(text, str) else []


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the character table for the trigrams of <word>, word after word, and how many each word has."""
    n = np.array([len(w) for w in words], dtype=np.int64)
    a = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    at = np.arange(n.sum()) + 2 * np.repeat(np.arange(len(n)), n)
    mixed = a[at] * 0x9E3779B1 + a[at + 1] * 0x85EBCA77 + a[at + 2] * 0xC2B2AE3D
    return ((mixed ^ mixed >> 15) * 0x27D4EB2F >> 12) % CHAR_ROWS, n


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Net:
    """Parameters p: E, C (embeddings), W, U, b (for each direction), v (attention), o and c (output)."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 1):
        r, d = np.random.default_rng(seed), WORD_DIM + CHAR_DIM
        self.vocabulary = vocabulary
        self.p = {"E": r.normal(0, 0.1, (len(vocabulary) + 1, WORD_DIM)), "C": r.normal(0, 0.1, (CHAR_ROWS, CHAR_DIM)),
                  "v": r.normal(0, 0.3, 2 * HIDDEN), "o": r.normal(0, 0.3, 2 * HIDDEN), "c": np.array(-1.0)}
        for s in "fb":
            self.p |= {f"W{s}": r.normal(0, d**-0.5, (d, 3 * HIDDEN)), f"U{s}": r.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)), f"b{s}": np.zeros(3 * HIDDEN)}

    def inputs(self, words: list[str]) -> np.ndarray:
        """A row for each word: its embedding and the mean of its trigrams'."""
        own = self.p["E"][[self.vocabulary.get(w, 0) for w in words]]
        grams, n = trigrams(words)
        flat = self.p["C"][grams]
        mean = np.add.reduceat(flat, np.r_[0, np.cumsum(n)[:-1]], axis=0) / n[:, None] if len(n) else flat
        return np.c_[own, mean]

    def run(self, a: np.ndarray, mask: np.ndarray, s: str, keep: bool = False):
        """Hidden states (time, window, unit) of one direction from projected inputs a (time, window, 3 * unit)."""
        u, h = self.p[f"U{s}"].astype(a.dtype), np.zeros((a.shape[1], HIDDEN), dtype=a.dtype)
        out, saved = np.empty((len(a), *h.shape), dtype=a.dtype), []
        for t in range(len(a)) if s == "f" else range(len(a) - 1, -1, -1):
            g = h @ u
            zr = _sigmoid(a[t][:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(a[t][:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if not mask[t].all():
                new = np.where(mask[t][:, None], new, h)
            if keep:
                saved.append((t, h, z, r, n, g[:, 2 * HIDDEN :]))
            out[t] = h = new
        return out, saved

    def forward(self, af: np.ndarray, ab: np.ndarray, mask: np.ndarray, inside: np.ndarray, keep: bool = False):
        """Logits of windows read with their context: mask tells the words there are, inside those of the window."""
        hf, sf = self.run(af, mask, "f", keep)
        hb, sb = self.run(ab, mask, "b", keep)
        h = np.concatenate((hf, hb), axis=2)
        e = np.where(inside, h @ self.p["v"].astype(h.dtype), -1e9)
        w = np.exp(e - e.max(0)) * inside
        w /= np.maximum(w.sum(0), 1e-9)
        pooled = (w[:, :, None] * h).sum(0)
        return pooled @ self.p["o"].astype(h.dtype) + float(self.p["c"]), (h, w, pooled, sf, sb)

    def gradients(self, ids: np.ndarray, mask: np.ndarray, inside: np.ndarray, x: np.ndarray, y: np.ndarray):
        """Loss and gradients over windows ids (time, window) into the input rows x, labels y; also the gradient of x."""
        p, g = self.p, {}
        at = x[ids]
        logit, (h, w, pooled, sf, sb) = self.forward(at @ p["Wf"] + p["bf"], at @ p["Wb"] + p["bb"], mask, inside, True)
        prob = _sigmoid(logit)
        d = (prob - y) / len(y)
        g["o"], g["c"] = pooled.T @ d, d.sum()
        dp = d[:, None] * p["o"]
        dw = (h * dp).sum(2)
        de = w * (dw - (w * dw).sum(0))
        dh = w[:, :, None] * dp + de[:, :, None] * p["v"]
        g["v"] = (de[:, :, None] * h).sum((0, 1))
        dx = np.zeros_like(at)
        for s, saved, own in (("f", sf, dh[:, :, :HIDDEN]), ("b", sb, dh[:, :, HIDDEN:])):
            u, gu, da, back = p[f"U{s}"], np.zeros_like(p[f"U{s}"]), np.zeros((*ids.shape, 3 * HIDDEN)), np.zeros((ids.shape[1], HIDDEN))
            for t, before, z, r, n, gn in reversed(saved):
                m = mask[t][:, None]
                full = (own[t] + back)
                dn, dz = np.where(m, full * (1 - z), 0) * (1 - n * n), np.where(m, full * (before - n), 0) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                gate = np.c_[dz, dr, dn * r]
                da[t] = np.c_[dz, dr, dn]
                gu += before.T @ gate
                back = np.where(m, full * z, full) + gate @ u.T
            g[f"U{s}"], g[f"b{s}"] = gu, da.sum((0, 1))
            g[f"W{s}"] = np.einsum("twd,twg->dg", at, da)
            dx += da @ p[f"W{s}"].T
        rows = np.zeros_like(x)
        np.add.at(rows, ids.ravel(), (dx * mask[:, :, None]).reshape(-1, x.shape[1]))
        loss = -np.mean(y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))
        return loss, g, rows


def starts_of(n: np.ndarray) -> np.ndarray:
    """How many windows texts of n words have: one from every word that a whole window follows, at least one."""
    return np.where(n > 0, np.maximum(n - WINDOW, 0) + 1, 0)


def _grid(starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of windows and their context, (time, window), which of them lie in the text (low to high), and which in the window."""
    at = starts[None, :] + np.arange(-CONTEXT, WINDOW + CONTEXT)[:, None]
    mask = (at >= low) & (at < high) & (at < ends + CONTEXT)
    return np.clip(at, low, np.maximum(high - 1, 0)), mask, mask & (at >= starts) & (at < ends)


def _windowed(x: np.ndarray) -> np.ndarray:
    """Sums of WINDOW rows from each row on; past the end there are zeros."""
    def more(a: np.ndarray, by: int, b: np.ndarray | None = None) -> np.ndarray:
        out = a.copy()
        out[: max(0, len(a) - by)] += (a if b is None else b)[by:]
        return out

    eight = more(more(more(x, 1), 2), 4)
    return more(more(eight, 8), 16, eight)


def _adam(moment: list[np.ndarray], rows, d: np.ndarray, step: int, rate: float = 0.01) -> np.ndarray:
    """The step of the given rows."""
    m, v = moment
    m[rows] = 0.9 * m[rows] + 0.1 * d
    v[rows] = 0.999 * v[rows] + 0.001 * d * d
    return rate * (m[rows] / (1 - 0.9**step)) / (np.sqrt(v[rows] / (1 - 0.999**step)) + 1e-8)


def train(texts: list[str], labels: list[int], rounds: int = 3, epochs: int = 5, seed: int = 1) -> Net:
    """A network from documents with label 1 or 0."""
    docs = [words_of(t) for t in texts]
    y = np.array([int(v > 0) for v in labels])
    held = Counter(w for d in docs for w in set(d))
    toxic = Counter(w for d, v in zip(docs, y, strict=True) if v for w in set(d))
    common = sorted(w for w, n in held.items() if n >= 3)
    net = Net({w: i + 1 for i, w in enumerate(common)}, seed)
    if not len(y) or y.min() == y.max():
        return net
    n1, n0 = y.sum(), (1 - y).sum()
    odds = {w: np.log((toxic[w] + 0.5) / (n1 + 1)) - np.log((held[w] - toxic[w] + 0.5) / (n0 + 1)) for w in common}
    vocab = sorted(held)
    row = {w: i for i, w in enumerate(vocab)}
    ids = [np.array([row[w] for w in d], dtype=np.int64) for d in docs]
    first = np.array([max(0.0, odds.get(w, 0.0)) ** 2 for w in vocab])  # the first pick of windows: words that mark the label
    n = np.array([len(d) for d in ids])
    base, many, flat = np.cumsum(n) - n, starts_of(n), np.concatenate(ids)
    doc = np.repeat(np.arange(len(n)), many)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    end = np.minimum(n[doc], start + WINDOW)
    sums = np.r_[0, np.cumsum(first[flat])]
    rating = sums[base[doc] + end] - sums[base[doc] + start]
    net.p["E"][1:, 0] = [np.clip(odds[w], -3, 3) for w in common]
    r, step = np.random.default_rng(seed), 0
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    of_word = np.array([net.vocabulary.get(w, 0) for w in vocab])
    grams, n_grams = trigrams(vocab)
    first_gram = np.cumsum(n_grams) - n_grams
    for _ in range(rounds):
        order = np.lexsort((-rating, doc))
        top = order[np.r_[True, doc[order][1:] != doc[order][:-1]]]
        clean = np.flatnonzero(y[doc] == 0)
        apart = clean[start[clean] % CONTEXT == 0]  # neighbours say the same
        worst = apart[np.argsort(-rating[apart], kind="stable")[: len(top)]]
        picked = np.concatenate((top, worst, r.choice(clean, min(len(clean), len(top)), replace=False)))
        for _ in range(max(epochs, 80 * 256 // max(1, len(picked)))):  # small samples need as many steps
            r.shuffle(picked)
            for i in range(0, len(picked), 256):
                own = picked[i : i + 256]
                here = doc[own]
                at, mask, inside = _grid(base[here] + start[own], base[here] + end[own], base[here], base[here] + n[here])
                used, local = np.unique(flat[at], return_inverse=True)
                local = local.reshape(at.shape)
                x = net.inputs([vocab[j] for j in used])
                _, g, gx = net.gradients(local, mask, inside, x, y[here].astype(float))
                k_grams = n_grams[used]
                own_grams = grams[np.repeat(first_gram[used] - (np.cumsum(k_grams) - k_grams), k_grams) + np.arange(k_grams.sum())]
                step += 1
                for k, d in g.items():
                    net.p[k] = net.p[k] - _adam(moment[k], ..., d, step)
                for k, rows, d in (("E", of_word[used], gx[:, :WORD_DIM]), ("C", own_grams, np.repeat(gx[:, WORD_DIM:] / k_grams[:, None], k_grams, axis=0))):
                    few, put = np.unique(rows, return_inverse=True)
                    sums = np.zeros((len(few), d.shape[1]))
                    np.add.at(sums, put, d)
                    net.p[k][few] -= _adam(moment[k], few, sums, step)
        scorer = Scorer(net)
        rating = scorer.windows(scorer.rows(vocab)[flat], n)
    return net


class Scorer:
    """Scores windows with inputs already projected for each word; the memory of words is bounded."""

    def __init__(self, net: Net):
        self.net, self.row, self.projected = net, {}, np.zeros((0, 6 * HIDDEN), dtype=np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        row = self.row
        if len(row) > _KNOWN:
            self.row, self.projected = row, self.projected = {}, self.projected[:0]
        new = [w for w in set(words) if w not in row]
        if new:
            p, x = self.net.p, self.net.inputs(new)
            more = np.c_[x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"]].astype(np.float32)
            row.update(zip(new, range(len(self.projected), len(self.projected) + len(new)), strict=True))
            self.projected = np.concatenate((self.projected, more))
        return np.array([row[w] for w in words], dtype=np.int64)

    def windows(self, flat: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Logits of every window of texts of n words, whose projected rows are flat, text after text."""
        p, many, base = self.net.p, starts_of(n), np.cumsum(n) - n
        out, first = np.empty(many.sum()), np.cumsum(many) - many
        tiles = -(-many // TILE)
        doc = np.repeat(np.arange(len(n)), tiles)
        begin = (np.arange(len(doc)) - np.repeat(np.cumsum(tiles) - tiles, tiles)) * TILE
        last = np.minimum(begin + TILE, many[doc])  # of its windows, exclusive
        low, high = np.maximum(begin - CONTEXT, 0), np.minimum(last - 1 + WINDOW + CONTEXT, n[doc])
        order = np.argsort(high - low, kind="stable")
        for i in range(0, len(order), 512):
            own = order[i : i + 512]
            t = np.arange((high - low)[own].max())[:, None]
            mask = t < (high - low)[own]
            a = self.projected[flat[base[doc[own]] + np.minimum(low[own] + t, high[own] - 1)]]
            hf, _ = self.net.run(a[:, :, : 3 * HIDDEN], mask, "f")
            hb, _ = self.net.run(a[:, :, 3 * HIDDEN :], mask, "b")
            v, o = p["v"].astype(np.float32), p["o"].astype(np.float32)
            e = np.where(mask, hf @ v[:HIDDEN] + hb @ v[HIDDEN:], -np.inf)
            w = np.exp(e - e.max(0)).astype(np.float64)
            logit = _windowed(w * (hf @ o[:HIDDEN] + hb @ o[HIDDEN:])) / np.maximum(_windowed(w), 1e-300) + float(p["c"])
            place = low[own] + t
            ok = (place >= begin[own]) & (place < last[own])
            out[(first[doc[own]] + place)[ok]] = logit[ok]
        return out


def score_texts(scorer: Scorer, texts: list) -> np.ndarray:
    """The worst window's probability for each text, to six places; 0 for a text without a word."""
    docs = [words_of(t) for t in texts]
    n = np.array([len(d) for d in docs], dtype=np.int64)
    out, some = np.zeros(len(docs)), n > 0
    if some.any():
        logit = scorer.windows(scorer.rows([w for d in docs for w in d]), n)
        many = starts_of(n)[some]
        out[some] = np.round(_sigmoid(np.maximum.reduceat(logit, np.cumsum(many) - many)), 6)  # equal texts differ in the tenth place by where they lie
    return out


def _score(net: Net):
    kept: list[Scorer] = []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not kept:
            kept.append(Scorer(net))
        for pdf in batches:
            texts = pdf.pop("text").tolist()
            score = np.concatenate([score_texts(kept[0], texts[i : i + 128]) for i in range(0, len(texts), 128)] or [np.zeros(0)])
            yield pdf.assign(score=score, predicted=(score >= 0.5).astype("int32"))

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Net:
    """A network from at most `sample` labelled documents, picked by a hash; null labels are none."""
    few = labelled_sample(docs, labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "toxic"), sample)
    rows = few.where("text IS NOT NULL").select("doc_id", "text", "toxic").toPandas().sort_values("doc_id")
    return train(rows["text"].tolist(), rows["toxic"].tolist())


def score(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, held_out, score, predicted for each row.

    - null text, or one without a word: 0; a null doc_id is a row like any other (held_out is false)
    - repeated rows are each scored; very long texts are scored window by window, whole
    - empty table: no rows; other columns are not read and may have any names
    """
    reach_workers(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return with_ids(docs.select(id_text(), held.alias("held_out"), "text").mapInPandas(_score(net), "doc_id string, held_out boolean, score double, predicted int"))
