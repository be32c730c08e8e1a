"""Exact top-k inner-product search by columnar branch-and-bound.

Vectors are dealt into blocks of bounded size, kept in vertical layout (one row of the matrix for each dimension).  Every
query block meets every candidate block once; there partial products grow dimension block by dimension block, and after each
one the candidates whose best possible product (partial plus the Cauchy-Schwarz bound on the dimensions that are left) falls
short of the k-th best guaranteed product are compacted away.  Survivors' products are whole integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, reach_workers

DIM_BLOCK = 8
BLOCK_ROWS = 4096


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v): floor(scale * x) of every component, as doubles; rows with nothing to compare take no part."""
    ok = F.expr(f"`{vec_col}` IS NOT NULL AND `{id_col}` IS NOT NULL AND forall(`{vec_col}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    v = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    big = F.transform(F.col(vec_col), lambda x: x.cast("double") * scale)  # beyond a long, doubles are whole already
    v = F.when(F.exists(F.col(vec_col), lambda x: F.abs(x.cast("double")) * scale > 9e15), big).otherwise(v)
    return vectors.where(ok).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _stack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks (block, width, ids, matrix) of one task's rows; rows of a width stand together, one dimension after another."""
    for pdf in batches:
        width = pdf["v"].map(len)
        for (block, w), g in pdf.groupby([pdf["block"], width]):
            m = np.array(g["v"].tolist(), dtype="<f8").reshape(len(g), int(w)).T
            yield pd.DataFrame({"block": [block], "width": [int(w)], "ids": [g["id"].to_numpy("<i8").tobytes()], "matrix": [np.ascontiguousarray(m).tobytes()]})


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, step: int = DIM_BLOCK) -> list[tuple[int, int, int]]:
    """(query, candidate, product) of each query's k best candidates; q and x hold a dimension in each row."""
    dims = x.shape[0]
    top = max(1.0, np.abs(x).max(initial=0)) * max(1.0, np.abs(q).max(initial=0)) * max(1, dims)
    exact = top < 2**52
    cuts = list(range(0, dims, step)) or [0]
    x_left = [np.sqrt((x[c:] ** 2).sum(0)) for c in [*cuts[1:], dims]]
    q_left = [np.sqrt((q[c:] ** 2).sum(0)) for c in [*cuts[1:], dims]]
    out = []
    for j, query in enumerate(q_ids):
        alive = np.flatnonzero(ids != query)
        if not exact:  # Python's own integers, which do not overflow
            xi, qi = x[:, alive].astype(object), q[:, j].astype(object)
            got = [sum(int(a) * int(b) for a, b in zip(qi, col, strict=True)) for col in xi.T]
            part = np.array([max(-(2**63), min(2**63 - 1, g)) for g in got], dtype=np.int64)
        else:
            part = np.zeros(len(alive))
            for n, c in enumerate(cuts):
                part = part + q[c : c + step, j] @ x[c : c + step, alive]
                if len(alive) > k and n + 1 < len(cuts):
                    slack = x_left[n][alive] * q_left[n][j] * (1 + 1e-9) + 1e-6
                    floor = np.partition(part - slack, len(alive) - k)[len(alive) - k]
                    keep = part + slack >= floor
                    if not keep.all():
                        alive, part = alive[keep], part[keep]
            part = part.astype(np.int64)
        order = np.lexsort((ids[alive], -part.astype(object) if not exact else -part))[:k]
        out += [(int(query), int(ids[alive[o]]), int(part[o])) for o in order]
    return out


def _search(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids, q_ids = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.q_ids, "<i8")
                x = np.frombuffer(r.matrix, "<f8").reshape(r.width, len(ids))
                q = np.frombuffer(r.q_matrix, "<f8").reshape(r.q_width, len(q_ids))
                w = min(r.width, r.q_width)
                yield pd.DataFrame(best(q_ids, q[:w], ids, x[:w], k), columns=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest integer inner products, ties to the smaller vec_id.

    vectors and queries are (id, v) as whole_vectors() makes them.
    - a query's own id is no candidate; rows that repeat an id are candidates each
    - null vectors, null or non-finite components, null ids: no part; vectors of unequal length are compared over the
      dimensions both have
    - products beyond a long are held at its ends
    - empty table, or no candidates: no rows
    """
    reach_workers(vectors.sparkSession)
    n = parts(vectors.sparkSession)

    def blocks(df: DataFrame, rows: int) -> DataFrame:
        many = max(1, -(-df.count() // rows))
        put = df.withColumn("block", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(many)).cast("int"))
        return put.repartition(max(n, many), "block").mapInPandas(_stack, "block int, width int, ids binary, matrix binary"), many

    mine, many = blocks(vectors, block_rows)
    theirs, q_many = blocks(queries, max(256, block_rows // 4))
    pair = mine.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_many - 1)))).hint("shuffle_merge").join(
        theirs.select(F.col("block").alias("q_block"), F.col("width").alias("q_width"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(many - 1)))), ["block", "q_block"])
    found = pair.mapInPandas(_search(k), "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
