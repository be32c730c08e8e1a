"""Soft-membership mixing of a corpus to target domain weights.

A classifier fitted on the labelled table gives every document a posterior over domains.  Projected-gradient least squares
then fits nonnegative document rates r so that the expected domain totals, the sum of r * tokens * posterior, match the
targets, with a small pull of every rate to 1.  A domain's squared difference weighs as one over its target, so that small
domains are fitted as closely, and in as few steps, as large ones.  Only the domain totals (one row) come to the driver in
each iteration; a step is a built-in expression of a document's rate, its posterior and the residuals.  Every few steps the
rates (without the texts) are written down and the next ones start from there, until the residuals stand still.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, labelled_sample, reach_workers, written

DOMAINS = ("good", "low", "toxic")
#: Shares of the tokens that mixed text should have.
TARGETS = {"good": 0.85, "low": 0.10, "toxic": 0.05}
SAMPLE = 3000
PULL = 0.02
#: A target below this share weighs as this share.
LEAST_SHARE = 1e-3
#: The fit ends when no weighed residual is larger than this, or none has moved by a fifth of it in a step.
TOLERANCE = 1e-4
_STEPS = 12
_STRIP = ".,;:!?\"'()[]#*$%&|<>"
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 1
_CLASS[[*range(65, 91)]] = 2
_CLASS[[*range(48, 58)]] = 3
_CLASS[[ord(c) for c in "!?"]] = 4
_CLASS[[ord(c) for c in " \t\n\v\f\r"]] = 5


def domain_column():
    """The labelled domain: toxic before low before good; null where a label is missing."""
    return F.when(F.col("toxic") > 0, "toxic").when((F.col("quality") == 0) & F.col("toxic").isNotNull(), "low").when((F.col("quality") > 0) & F.col("toxic").isNotNull(), "good")


def words_in(text: str) -> list[str]:
    return [w for w in _SPACE.split(text) if w]


def features(text, lexicon: dict[str, np.ndarray]) -> tuple[int, np.ndarray]:
    """Words of a whole text, and shares of character classes, the text's length and the strongest word of each domain."""
    text = text if isinstance(text, str) else ""
    words = words_in(text)
    share = np.bincount(_CLASS[np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)], minlength=6)[1:5] / max(1, len(text))
    seen = set(words)
    hits = [lexicon[w] for w in seen if w in lexicon]
    hits += [lexicon[s] for w in seen if w[-1] in _STRIP or w[0] in _STRIP or w[0].isupper() for s in (w.strip(_STRIP).lower(),) if s in lexicon]
    top = np.max(hits, axis=0) if hits else np.zeros(len(DOMAINS))
    return len(words), np.r_[np.minimum(1, 5 * share), np.log1p(len(words)) / 8, len(words) < 10, len(seen) / max(1, len(words)), np.maximum(0, top) / 3, 1.0]


class Model:
    """Softmax regression over features(); lexicon has the words that mark a domain in the sample."""

    def __init__(self, lexicon: dict[str, np.ndarray], weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def posterior(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def train(texts: list[str], domains: list[str], rounds: int = 600) -> Model:
    """A model from texts and their domains; without any, all domains are as likely."""
    y = np.array([[d == k for k in DOMAINS] for d in domains], dtype=float).reshape(-1, len(DOMAINS))
    held: dict[str, np.ndarray] = {}
    many: Counter = Counter()
    for text, row in zip(texts, y, strict=True):
        for w in {w.strip(_STRIP).lower() for w in words_in(text)} - {""}:
            held[w] = held.get(w, 0) + row
            many[w] += 1
    n = y.sum(0)
    lexicon = {}
    for w, c in held.items():
        if many[w] >= 5:
            odds = np.log((c + 0.5) / (n + 1)) - np.log((c.sum() - c + 0.5) / (n.sum() - n + 1))
            if odds.max() > 1.5:
                lexicon[w] = np.clip(odds, -4, 4)
    weights = np.zeros((8 + len(DOMAINS), len(DOMAINS)))
    if len(texts):
        x = np.array([features(t, lexicon)[1] for t in texts])
        for i in range(rounds):
            z = x @ weights
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            weights -= 4.0 * (x.T @ (p - y) / len(x) + 1e-4 * weights)
    return Model(lexicon, weights)


def fit_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most `sample` labelled documents, picked by a hash of their ids."""
    known = labels.where("doc_id IS NOT NULL").select("doc_id", domain_column().alias("domain")).where("domain IS NOT NULL")
    rows = labelled_sample(docs, known, sample).where("text IS NOT NULL").select("doc_id", "text", "domain").toPandas().sort_values("doc_id")
    return train(rows["text"].tolist(), rows["domain"].tolist())


def memberships(docs: DataFrame, model: Model) -> DataFrame:
    """docs (their columns as struct d) with n_tokens, the words of the whole text, and p, the posterior over DOMAINS."""
    reach_workers(docs.sparkSession)

    @F.pandas_udf("n long, p array<double>")
    def member(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            got = [features(t, model.lexicon) for t in texts]
            p = model.posterior(np.array([g[1] for g in got])) if got else np.zeros((0, len(DOMAINS)))
            yield pd.DataFrame({"n": [g[0] for g in got], "p": list(p)})

    return docs.select(F.struct("*").alias("d"), member(F.col("text")).alias("m")).select("d", F.col("m.n").alias("n_tokens"), F.col("m.p").alias("p"))


def stepped(rate: Column, p: Column, residuals: list[list[float]], step: float, pull: float, most: float | None) -> Column:
    """A rate after projected-gradient steps with these residuals."""
    for e in residuals:
        down = sum((p[i] * F.lit(step * x) for i, x in enumerate(e)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate * (1 - step * pull) + step * pull - down)
        rate = F.least(F.lit(float(most)), rate) if most is not None else rate
    return rate


def folded(p: Column, residuals: list[list[float]], step: float, pull: float, most: float | None) -> Column:
    """stepped() from a rate of 1, for any number of steps: the expression holds their residuals as one array."""
    if not residuals:
        return F.lit(1.0)

    def one(rate: Column, e: Column) -> Column:
        rate = F.greatest(F.lit(0.0), rate * (1 - step * pull) + step * pull - sum((p[i] * e[i] * step for i in range(len(DOMAINS))), F.lit(0.0)))
        return F.least(F.lit(float(most)), rate) if most is not None else rate

    return F.aggregate(F.array(*(F.array(*map(F.lit, e)) for e in residuals)), F.lit(1.0), one)


def fit_rates(members: DataFrame, targets: dict[str, float], keep: str | None = None, most: float | None = None, tol: float = TOLERANCE):
    """(members with rate, totals, wanted): rates at which the domain totals come as close to the wanted ones as rates from 0
    (to `most`) and the pull to 1 allow.  It iterates until the residuals stand still, however long that takes.

    Targets are shares of the tokens there are now; with keep, of so many that this domain's target is what it has now.
    """
    k = len(DOMAINS)
    now_at = members.select("n_tokens", "p").withColumn("rate", F.lit(1.0))

    def totals(rate: Column) -> np.ndarray:
        sums = now_at.agg(*(F.sum(F.col("n_tokens") * rate * F.col("p")[i]) for i in range(k)))
        return np.array([x or 0.0 for x in sums.first()])

    now = totals(F.col("rate"))
    want = np.array([targets[d] for d in DOMAINS], dtype=float)
    want = want / want.sum() * (now.sum() if keep is None else now[DOMAINS.index(keep)] / (want[DOMAINS.index(keep)] / want.sum()))
    size = max(1.0, now.sum())
    weight = 1 / np.maximum(want / size, LEAST_SHARE)
    step = 1 / (max(1e-9, (weight * now / size).max()) + PULL)  # a bound of the curvature: the largest row sum, as posteriors sum to 1
    last, steps, history, table_ = None, [], [], None
    while True:
        e = weight * (now - want) / size
        if np.abs(e).max() < tol or (last is not None and np.abs(e - last).max() < tol / 5):
            break
        last = e
        steps.append([float(x) for x in e])
        history.append(steps[-1])
        now = totals(stepped(F.col("rate"), F.col("p"), steps, step, PULL, most))
        if len(steps) == _STEPS:
            before, table_ = table_, written(now_at.withColumn("rate", stepped(F.col("rate"), F.col("p"), steps, step, PULL, most)), "rates")
            now_at, steps = table_, []
            if before is not None:
                discard(before)
    if table_ is not None:
        discard(table_)
    return members.withColumn("rate", folded(F.col("p"), history, step, PULL, most)), now, want


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, keep: str | None = None, sample: int = SAMPLE, most: float | None = None) -> DataFrame:
    """Every row of docs as struct d, with n_tokens, p (posterior of each of DOMAINS) and rate.

    - null or empty text: no tokens, a posterior by its features, and the rate that goes with it
    - repeated rows have one rate each; a null doc_id is a row like any other
    - very long texts are read whole; empty table: no rows; no labels: all domains as likely
    - other columns may have any names
    """
    members = written(memberships(docs, fit_model(docs, labels, sample)), "memberships")
    return fit_rates(members, targets or TARGETS, keep, most)[0]


def thinned(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, keep: str = "good") -> DataFrame:
    """docs after mixing by thinning: the kept domain stays as large as it is and sets the scale for the others.

    A row stays with the probability of its rate (at most 1), drawn from a hash of its id and text; one most likely of the
    kept domain stays.  A domain with less than its target stays whole.
    """
    draw = F.pmod(F.xxhash64(F.col("d.doc_id"), F.col("d.text"), F.lit(11)), F.lit(1 << 30)) / (1 << 30)
    clean = F.array_position("p", F.array_max("p")) == DOMAINS.index(keep) + 1
    return mix(docs, labels, targets, keep, most=1.0).where(clean | (draw < F.col("rate"))).select("d.*")
