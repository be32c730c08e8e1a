"""Quality rules as weak supervision: rules vote or abstain, EM estimates their accuracies, a posterior decides.

Native: the executors run built-in expressions only.  The driver sees one row for each distinct vote pattern, at most
3 ** len(RULES) rows, whatever the input's size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SPACE = r"[\\x20\\x09-\\x0D]+"

#: One row of counts for the word array `w` of a text.  `let` style: transform(array(x), v -> ...)[0] evaluates x once.
COUNTS = rf"""
transform(array(array_remove(split(coalesce(text, ''), '{SPACE}'), '')), w ->
  named_struct(
    'n_words', cast(size(w) AS BIGINT),
    'word_chars', cast(char_length(array_join(w, '')) AS BIGINT),
    'n_symbols', cast(regexp_count(coalesce(text, ''), '[#*$%&|<>]') AS BIGINT),
    'n_upper', cast(regexp_count(coalesce(text, ''), '[A-Z]') AS BIGINT),
    'n_lines', cast(size(split(coalesce(text, ''), '\n')) AS BIGINT),
    'n_dup_lines', transform(array(filter(split(coalesce(text, ''), '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')),
        ls -> cast(size(ls) - size(array_distinct(ls)) AS BIGINT))[0],
    'n_repeat_words', IF(size(w) < 6, 0L, transform(array(
        transform(sequence(0, size(w) - 5), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))), h ->
        IF(size(array_distinct(h)) = size(h), 0L,
          transform(array(array_sort(transform(h, (x, i) -> named_struct('x', x, 'i', i)))), s ->
            transform(array(array_sort(filter(
                transform(s, (e, k) -> IF((k > 0 AND s[greatest(k - 1, 0)].x = e.x)
                    OR (k + 1 < size(s) AND s[least(k + 1, size(s) - 1)].x = e.x), e.i, -1)), i -> i >= 0))), p ->
              aggregate(sequence(0, size(p) - 1), 0L, (a, k) ->
                a + IF(k + 1 < size(p), least(5, p[least(k + 1, size(p) - 1)] - p[k]), 5)))[0])[0]))[0])
  ))[0]
"""

#: name, SQL of a vote: 1 good, 0 bad, -1 abstains.  Thresholds are per word, line or character, so any size of text fits.
RULES = (
    ("length", "CASE WHEN n_words < 10 THEN 0 WHEN n_words >= 40 THEN 1 ELSE -1 END"),
    ("symbols", "CASE WHEN 100 * n_symbols > 20 * n_words THEN 0 WHEN 100 * n_symbols <= 5 * n_words THEN 1 ELSE -1 END"),
    ("dup_lines", "CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 0 WHEN 100 * n_dup_lines <= 5 * n_lines THEN 1 ELSE -1 END"),
    ("repeats", "CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 0 WHEN 100 * n_repeat_words <= 5 * n_words THEN 1 ELSE -1 END"),
    ("word_length", "CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 0 WHEN word_chars BETWEEN 3 * n_words AND 12 * n_words THEN 1 ELSE -1 END"),
    ("capitals", "CASE WHEN 100 * n_upper > 40 * word_chars THEN 0 WHEN 100 * n_upper <= 15 * word_chars THEN 1 ELSE -1 END"),
)


def fit(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = 200) -> tuple[float, list[tuple[float, float]]]:
    """EM over vote patterns: share of good texts, and for each rule P(votes good | good), P(votes bad | bad) if it votes.

    The accuracies have Beta(8, 2) priors and start at 0.8: rules are taken to be better than chance, which keeps the
    two classes from changing places.
    """
    good, rates = 0.8, [(0.8, 0.8)] * rules
    for _ in range(rounds):
        soft = [(v, n, posterior(v, good, rates)) for v, n in patterns]
        total = sum(n for _, n, _ in soft)
        new_good = (8 + sum(n * p for _, n, p in soft)) / (10 + total)
        new = []
        for j in range(rules):
            g = [(n * p, v[j]) for v, n, p in soft if v[j] >= 0]
            b = [(n * (1 - p), v[j]) for v, n, p in soft if v[j] >= 0]
            new.append(tuple(
                min(0.999, max(0.55, (8 + sum(x for x, y in side if y == want)) / (10 + sum(x for x, _ in side))))
                for side, want in ((g, 1), (b, 0))
            ))
        moved = abs(new_good - good) + sum(abs(a - c) + abs(b - d) for (a, b), (c, d) in zip(new, rates, strict=True))
        good, rates = new_good, new
        if moved < 1e-9:
            break
    return good, rates


def weights(good: float, rates: list[tuple[float, float]]) -> tuple[float, list[tuple[float, float]]]:
    """Log odds of the prior, and for each rule what a vote for good or for bad adds."""
    good = min(0.999, max(0.001, good))
    return math.log(good / (1 - good)), [(math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in rates]


def posterior(votes: tuple[int, ...], good: float, rates: list[tuple[float, float]]) -> float:
    base, adds = weights(good, rates)
    z = base + sum(0.0 if v < 0 else (up if v else down) for v, (up, down) in zip(votes, adds, strict=True))
    return 1 / (1 + math.exp(-z))


def judge(docs: DataFrame, least: float = 0.5, carry: bool = False) -> DataFrame:
    """Each row's doc_id, counts, votes, quality (posterior probability) and kept; with carry also the row, as struct d.

    - null or empty text: no words, base_failed, not kept; a null doc_id is a row like any other
    - repeated rows: each is judged and returned
    - very long texts: whole texts are read; 5-word windows are compared by a 64-bit hash within the text
    - empty table: no rows (the posterior then rests on the priors)
    - other columns of docs are not read and may have any names
    """
    votes = [f"v_{name}" for name, _ in RULES]
    row = [F.struct("*").alias("d")] if carry else []
    table = written(
        docs.select("doc_id", *row, F.expr(COUNTS).alias("m")).select("doc_id", *(["d"] if carry else []), "m.*")
        .withColumns({f"v_{n}": F.expr(e) for n, e in RULES}), "quality-counts",
    )
    seen = table.groupBy(*votes).count().collect()  # at most 3 ** len(RULES) rows
    base, adds = weights(*fit([(tuple(r[:-1]), r[-1]) for r in seen], len(RULES)))
    z = F.lit(base)
    for v, (up, down) in zip(votes, adds, strict=True):
        z = z + F.when(F.col(v) == 1, up).when(F.col(v) == 0, down).otherwise(0.0)
    failed = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    return table.withColumn("quality", 1 / (1 + F.exp(-z))).withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= least)
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their columns."""
    return judge(docs, carry=True).where("kept").select("d.*")
