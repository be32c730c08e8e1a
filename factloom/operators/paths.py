"""Path containment as equi-joins on a path's own ancestors, so that no pair of unrelated paths is compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(path: Column) -> Column:
    """Every proper ancestor of a path, the shortest first; none for a path of one segment."""
    parts = F.split(path, "/")
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: k > 0), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def nearest_root(paths: DataFrame, path: str, roots: DataFrame, root: str) -> DataFrame:
    """paths with the longest root that contains each, null where none does."""
    up = paths.select(path, F.explode(ancestors(F.col(path))).alias(root)).distinct()
    best = up.join(roots.select(root).distinct(), root).groupBy(path).agg(F.max_by(root, F.length(root)).alias(root))
    return paths.join(best, path, "left")


def uncovered(scopes: DataFrame, scope: str) -> DataFrame:
    """Distinct scopes that no other scope contains."""
    own = scopes.select(scope).distinct()
    within = own.select(F.col(scope).alias("_inner"), F.explode(ancestors(F.col(scope))).alias(scope)).join(own, scope, "left_semi")
    return own.join(within.select(F.col("_inner").alias(scope)), scope, "left_anti")


def unreflected(rows: DataFrame, prefix: str, path: str) -> DataFrame:
    """(prefix, unreflected): whether any path lies outside the prefix, whole segments only."""
    inside = (F.col(path) == F.col(prefix)) | F.startswith(F.col(path), F.concat(F.col(prefix), F.lit("/")))
    return rows.groupBy(prefix).agg(F.bool_or(~inside).alias("unreflected"))


def case_collisions(rows: DataFrame, path: str) -> DataFrame:
    """(folded, spellings) of paths that differ only in case."""
    return rows.groupBy(F.lower(path).alias("folded")).agg(F.count_distinct(path).alias("spellings")).where("spellings > 1")
