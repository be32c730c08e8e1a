"""Language identification by rank-order profiles of character n-grams (1 to 3 letters, words padded with one space).

A language's profile is its TOP most frequent n-grams over a bounded sample of labelled texts; a document's profile is made
alike from its whole text.  The out-of-place distance adds up how far each of the document's n-grams stands from its place
in the language's profile, TOP for one that is not there; the nearest language wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, reach_workers, with_ids

TOP = 300
PER_LANGUAGE = 400
_tables: dict = {}


def _letters(text: str) -> np.ndarray:
    """Lower-case code points with one 0 for each run of other characters, and a 0 at both ends; empty without letters."""
    if "alpha" not in _tables:
        _tables["alpha"] = np.array([chr(i).isalpha() for i in range(0x10000)])
    a = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    high = a >= 0x10000
    ok = _tables["alpha"][np.where(high, 0, a)]
    if high.any():
        ok[high] = [chr(c).isalpha() for c in a[high]]
    if not ok.any():
        return np.zeros(0, dtype=np.int64)
    a = np.where(ok, a, 0)
    return a[np.concatenate(([True], (a[1:] != 0) | (a[:-1] != 0)))]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of a text as numbers (21 bits a character, 1 for a space), and their counts."""
    a = _letters(text)
    if not len(a):
        return a, a
    b = np.where(a == 0, 1, a)
    two = b[:-1] << 21 | b[1:]
    three = (two[:-1] << 21 | b[2:])[a[1:-1] != 0]
    return np.unique(np.concatenate((b[a != 0], two, three)), return_counts=True)


def ranked(text: str, top: int = TOP) -> np.ndarray:
    """The text's n-grams, most frequent first, ties by number."""
    g, n = grams(text)
    if len(g) > top:
        least = np.partition(n, len(n) - top)[len(n) - top]
        g, n = g[n >= least], n[n >= least]
    return g[np.lexsort((g, -n))][:top]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, group in pdf.groupby("lang"):
            g, n = zip(*(grams(t) for t in group["text"]), strict=True)
            g, at = np.unique(np.concatenate(g), return_inverse=True)
            yield pd.DataFrame({"lang": lang, "gram": g, "n": np.bincount(at, np.concatenate(n)).astype(np.int64)})


def profiles(labelled: DataFrame, top: int = TOP, per_language: int = PER_LANGUAGE) -> pd.DataFrame:
    """lang, gram, rank (from 0): top rows for each language, from at most per_language texts of each, picked by a hash."""
    reach_workers(labelled.sparkSession)
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    pick = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = known.select("doc_id", "lang").withColumn("r", F.row_number().over(pick)).where(F.col("r") <= per_language)
    texts = known.select("doc_id", "lang", "text").join(F.broadcast(few.select("doc_id", "lang").distinct()), ["doc_id", "lang"])
    counts = texts.select("lang", "text").mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(by) - 1).where(F.col("rank") < top).select("lang", "gram", "rank").toPandas()


def _predict(table: pd.DataFrame, top: int):
    langs = sorted(table["lang"].unique())
    union = np.unique(table["gram"].to_numpy(np.int64)) if langs else np.zeros(1, np.int64)
    place = np.full((len(union) + 1, max(1, len(langs))), -1, dtype=np.int64)
    for j, lang in enumerate(langs):
        own = table[table["lang"] == lang]
        place[np.searchsorted(union, own["gram"].to_numpy(np.int64)), j] = own["rank"].to_numpy()

    def one(text) -> tuple[str, float]:
        if not isinstance(text, str) or not langs:
            return "und", 0.0
        g = ranked(text, top)
        if not len(g):
            return "und", 0.0
        at = np.minimum(np.searchsorted(union, g), len(union) - 1)
        r = np.where((union[at] == g)[:, None], place[at], -1)
        off = np.where(r < 0, top, np.abs(r - np.arange(len(g))[:, None])).sum(0)
        j = int(off.argmin())
        return langs[j], 1 - off[j] / (top * len(g))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [one(t) for t in pdf.pop("text")]
            yield pdf.assign(lang_pred=[g[0] for g in got], score=np.array([g[1] for g in got], dtype=float))

    return run


def predict(docs: DataFrame, table: pd.DataFrame, top: int = TOP) -> DataFrame:
    """doc_id, held_out, lang_pred, score: the language whose profile is nearest to the whole text's, and how near (0 to 1).

    - null text, or one without letters: `und`, 0; likewise when no language was learned
    - a null doc_id is a row like any other (held_out is false); repeated rows are each scored; ties between languages go to the first by name
    - very long texts are read whole; empty table: no rows; other columns are not read and may have any names
    """
    reach_workers(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    schema = "doc_id string, held_out boolean, lang_pred string, score double"
    return with_ids(docs.select(id_text(), held.alias("held_out"), "text").mapInPandas(_predict(table, top), schema))
