"""Quality classifier by hierarchical empirical Bayes over hosts and their paths.

A logistic classifier on counts of the whole text gives each document's evidence.  Grouped sums (partial sums before any
shuffle) give each path and host a posterior mean, shrunk path to host to global by strengths estimated from the spread
between sites; a document's score adds its own evidence to its path's posterior without itself.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, written
from .quality_rules import COUNTS

SAMPLE = 8000
#: Shares that make the classifier's inputs; a text without words has all 0.
FEATURES = (
    "n_symbols / greatest(n_words, 1)", "n_upper / greatest(word_chars, 1)", "n_dup_lines / greatest(n_lines, 1)",
    "n_repeat_words / greatest(n_words, 1)", "least(word_chars / greatest(n_words, 1), 20) / 10", "ln(1 + n_words) / 5",
    "IF(n_words < 10, 1, 0)", "least(n_symbols / greatest(n_words, 1), 0.2)", "IF(n_upper > 0.4 * word_chars, 1, 0)",
)


def measures(docs: DataFrame) -> DataFrame:
    """docs with the classifier's inputs as array x."""
    kept = docs.columns
    m = docs.withColumn("m", F.expr(COUNTS)).select(*kept, "m.*")
    return m.select(*kept, F.array(*(F.expr(f"cast({e} AS DOUBLE)") for e in FEATURES)).alias("x"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = 400) -> tuple[list[float], float, float]:
    """Weights, intercept and base rate from at most `sample` labelled documents (null labels are no labels)."""
    few = labelled_sample(docs, labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "quality"), sample)
    rows = measures(few).select("x", "quality").collect()  # at most `sample` short rows
    if not rows:
        return [0.0] * len(FEATURES), 0.0, 0.5
    x, y = np.array([r[0] for r in rows]), np.array([float(r[1] > 0) for r in rows])
    mean, sd = x.mean(0), x.std(0) + 1e-6
    z, rate = (x - mean) / sd, (y.sum() + 1) / (len(y) + 2)
    a = np.c_[z, np.ones(len(z))]
    w = np.zeros(a.shape[1])
    w[-1] = math.log(rate / (1 - rate))
    for _ in range(min(rounds, 40)):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-a @ w))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.eye(len(w)) * (1 + 1e-3 * len(y))
        ridge = np.r_[w[:-1], 0] * (1 + 1e-3 * len(y))
        w = w + np.linalg.solve(h, a.T @ (y - p) - ridge)
    out = w[:-1] / sd
    return out.tolist(), float(w[-1] - (mean / sd) @ w[:-1]), float(rate)


def _logit(c: Column) -> Column:
    c = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), c))
    return F.ln(c / (1 - c))


def score(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, host, path, evidence, host_quality, path_quality, quality, kept (quality of 0.5 or more).

    host and path default to the source, and the source's part in one language.
    - null or empty text: scored by its counts, all 0; null host or path: a site of its own name, ''
    - repeated rows: each is scored and each counts; labels that repeat an id: one of them counts
    - very long texts are read whole; empty table: no rows; no labels: evidence of 0.5 for all
    - other columns may have any names
    """
    weights, base, rate = fit(docs, labels, sample)
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", F.col("source"), F.col("lang")) if path is None else path
    rows = measures(docs.select("doc_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), "text"))
    z = F.lit(base)
    for i, w in enumerate(weights):
        z = z + F.col("x")[i] * w
    table = written(rows.select("doc_id", "host", "path", (1 / (1 + F.exp(-z))).alias("evidence")), "evidence")
    paths = written(table.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("s"), F.sum(F.col("evidence") ** 2).alias("ss")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("h_n"), F.sum("s").alias("h_s"), F.count("*").alias("h_paths"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).first()
    n, mean = total["n"] or 0, (total["s"] or 0.0) / max(1, total["n"] or 0)

    def strength(sites: DataFrame, n: str, s: str, around: Column) -> float:
        """Rows that the prior counts for: variance within over variance between sites (moments; weights by rows)."""
        own = F.sum(F.col(s) * F.col(s) / F.col(n)).alias("own")
        got = sites.agg(F.sum(F.col(n) * (F.col(s) / F.col(n) - around) ** 2).alias("v"), F.sum(n).alias("n"), F.count("*").alias("k"), own).first()
        within = max(1e-6, ((total["ss"] or 0.0) - (got["own"] or 0.0)) / max(1, (got["n"] or 0) - got["k"]))
        between = max(1e-6, ((got["v"] or 0.0) - within * got["k"]) / max(1, got["n"] or 0))
        return min(1e6, max(1.0, within / between))

    k_host = strength(hosts, "h_n", "h_s", F.lit(mean))
    hosts = hosts.select("host", ((F.col("h_s") + k_host * mean) / (F.col("h_n") + k_host)).alias("host_quality"))
    joined = paths.join(hosts, "host")
    k_path = strength(joined, "n", "s", F.col("host_quality"))
    without = (F.col("s") - F.col("evidence") + k_path * F.col("host_quality")) / (F.col("n") - 1 + k_path)
    whole = (F.col("s") + k_path * F.col("host_quality")) / (F.col("n") + k_path)
    quality = 1 / (1 + F.exp(-(_logit(F.col("evidence")) - _logit(F.lit(rate)) + _logit(without))))
    return table.join(joined.drop("ss"), ["host", "path"]).select(
        "doc_id", "host", "path", "evidence", "host_quality", whole.alias("path_quality"), quality.alias("quality")
    ).withColumn("kept", F.col("quality") >= 0.5)
