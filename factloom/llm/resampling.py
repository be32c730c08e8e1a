"""Importance resampling towards the distribution of a target set, over hashed word n-grams.

Texts are cut into chunks of words: a chunk owns the n-grams that start at its words and carries the n - 1 words that follow,
so that the chunks of a text have each n-gram once.  Texts of at most a chunk's characters are chunks as they stand; longer
ones are cut in Spark and dealt out, so that one long text is the work of many tasks.  Counts of buckets are summed before
they are shuffled (at most `buckets` rows a task), weights of chunks are summed by document, and the drawn documents are
ranked by a sort over ranges and each range's offset; no task sees all of them.

The gains, one number a bucket, are the only thing that passes through the driver; their size does not grow with the data.

Defined results: a null or empty text has no features and weight 0.  Repeated rows and ids are documents of their own; equal
scores go to the smaller doc_id, a null one (in the seed: the empty text) last.  An empty table gives no rows, an empty target
has T = 0.  Other columns are dropped.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, reach_workers, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS, GRAMS, CHUNK_WORDS, CHUNK_CHARS = 10000, 2, 4096, 1 << 16
LEAST_WORDS, PERCENT, SEED = 20, 25, 7


def chunks(texts: DataFrame, grams: int = GRAMS, words: int = CHUNK_WORDS, chars: int = CHUNK_CHARS) -> DataFrame:
    """The rows of texts, those of over `chars` characters once for each `words` words: text is the chunk's, lower-cased, and
    own tells how many of its words the chunk owns; null stands for all of them."""
    whole = F.coalesce("text", F.lit(""))
    keys = [c for c in texts.columns if c != "text"]
    text = F.translate(whole, _UPPER, _LOWER)
    short = texts.where(F.length(whole) <= chars).select(*keys, text.alias("text"), F.lit(None).cast("int").alias("own"))
    split = texts.where(F.length(whole) > chars).select(*keys, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1)), F.lit(words))
    cut = split.withColumn("at", F.explode(starts)).select(*keys, F.array_join(F.slice("w", F.col("at"), F.lit(words + grams - 1)), " ").alias("text"), F.lit(words).alias("own"))
    return short.unionByName(cut.repartition(parts(texts.sparkSession)))


def features(text: str, own: int, grams: int, buckets: int) -> tuple[int, np.ndarray]:
    """How many words are owned (all, if own is negative), and the buckets of the n-grams that start at them."""
    words = _WORD_BYTES.findall(text.encode())
    last = len(words) if own < 0 else min(own, len(words))
    sums = list(map(zlib.crc32, words[:last]))
    found = [sums]
    for n in range(1, grams):
        sums = list(map(zlib.crc32, words[n:], map(zlib.crc32, repeat(b" "), sums)))
        found.append(sums)
    return last, np.concatenate([np.array(s, np.int64) for s in found]) % buckets


def _owned(own: pd.Series) -> np.ndarray:
    return own.fillna(-1).to_numpy(np.int64)


def bucket_counts(texts: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: the features in each bucket that has any."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for frame in frames:
            for text, own in zip(frame["text"], _owned(frame["own"])):
                total += np.bincount(features(text, own, grams, buckets)[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": used, "n": total[used]})

    reach_workers(texts.sparkSession)
    return chunks(texts.select("text"), grams).mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed share in the target to that in docs, rounded down."""
    held = []
    for texts in (target, docs):
        row = np.zeros(buckets)
        for r in bucket_counts(texts, grams, buckets).collect():  # at most `buckets` rows
            row[r["bucket"]] = r["n"]
        held.append(row)
    t, s = held
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, grams: int = GRAMS) -> DataFrame:
    """_row, doc_id, n_words, n_features and weight (the mean gain of the features, rounded down), one row a document."""

    @F.pandas_udf("struct<words: long, n: long, total: long>")
    def sums(text: pd.Series, own: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(text), 3), np.int64)
        for i, (t, o) in enumerate(zip(text, _owned(own))):
            n_words, found = features(t, o, grams, len(gain))
            out[i] = n_words, len(found), gain[found].sum()
        return pd.DataFrame(out, columns=["words", "n", "total"])

    reach_workers(docs.sparkSession)
    keyed = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    each = chunks(keyed, grams).select("_row", "doc_id", F.col("own").isNull().alias("short"), sums("text", "own").alias("x"))
    whole = each.groupBy("_row", "doc_id", "short").agg(*(F.sum(f"x.{c}").alias(c) for c in ("words", "n", "total")))
    down = F.when(F.col("n") == 0, F.lit(0).cast("long")).otherwise(F.expr("(total - pmod(total, n)) div n"))
    return whole.select("_row", "doc_id", F.col("words").alias("n_words"), F.col("n").alias("n_features"), down.alias("weight"))


def ranked(rows: DataFrame, *order) -> DataFrame:
    """rows with at: their place, from 1, in the given order, by sorted ranges and the offsets of the ranges."""
    n = parts(rows.sparkSession)
    placed = written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_id", 33).alias("_part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("_size"))  # a row for each of n ranges
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_part").alias("_of"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    joined = placed.join(F.broadcast(offsets), F.shiftright("_id", 33) == F.col("_of"))
    return joined.withColumn("at", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).drop("_id", "_of", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null for those that are not drawn.

    score is the weight with Gumbel noise from the id's hash, so that the highest scores are a draw without replacement with
    probabilities by weight; `percent` of the documents of `least` words or more are drawn."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(weighed(docs, gains(docs, target)).withColumn("score", F.col("weight") + noise), "scored")
    able = scored.where(F.col("n_words") >= least)
    most = percent * able.count() // 100
    drawn = ranked(able, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")).withColumn("rank", F.when(F.col("at") <= most, F.col("at")))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return drawn.select(*out).unionByName(scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")).select(*out))
