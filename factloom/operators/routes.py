"""Scanned endpoints against a document's operations and against observed runtime routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import route_shape


def prefix_deltas(endpoints: DataFrame, operations: DataFrame) -> DataFrame:
    """(delta, n): what the document's path has before the scanned one, for each pair of one operation id and verb."""
    pairs = endpoints.alias("e").join(operations.alias("o"), (F.col("e.operation_id") == F.col("o.operation_id")) & (F.col("e.verb") == F.col("o.verb")))
    long, short = route_shape(F.col("o.path")), route_shape(F.col("e.path"))
    delta = F.when(F.endswith(long, short), F.substring(long, F.lit(1), F.length(long) - F.length(short)))
    return pairs.select(delta.alias("delta")).where("delta IS NOT NULL").groupBy("delta").agg(F.count("*").alias("n"))


def inferred_prefix(deltas: DataFrame) -> DataFrame:
    """One row (value, origin, conflicting): the only delta there is, or none."""
    out = deltas.agg(F.count("*").alias("k"), F.min("delta").alias("one"), F.array_join(F.array_sort(F.collect_set("delta")), ",").alias("all"))
    one = F.col("k") == 1
    return out.select(F.when(one, F.col("one")).alias("value"), F.when(one, "inferred").otherwise("none").alias("origin"), F.when(F.col("k") > 1, F.col("all")).otherwise("").alias("conflicting"))


def reconcile(endpoints: DataFrame, operations: DataFrame, prefix: DataFrame) -> DataFrame:
    """(key, kind, reason, operation) of endpoints (key, verb, path, operation_id); prefix is one row (value).

    With an operation id: missing, drift of verb or path, or matched.  Without: the one operation of the verb whose route has
    the endpoint's shape, prefixed or bare, is adopted if it has an id; several are ambiguous.  Of operations that share an id
    the first counts, by ordinal where operations have one, else by path and verb.
    """
    rows = endpoints.join(F.broadcast(prefix.select("value")))
    full = route_shape(F.concat(F.coalesce("value", F.lit("")), F.col("path")))
    ops = operations.select("verb", "path", "operation_id", route_shape(F.col("path")).alias("shape"))
    place = F.struct(*(c for c in ("ordinal", "path", "verb") if c in operations.columns))
    by_id = operations.where("operation_id IS NOT NULL").groupBy("operation_id").agg(F.min_by(F.struct("verb", route_shape(F.col("path")).alias("shape")), place).alias("op"))
    kind = lambda k, reason="": F.struct(F.lit(k).alias("kind"), F.lit(reason).alias("reason"))
    named = rows.where("operation_id IS NOT NULL").join(by_id, "operation_id", "left")
    verdict = F.when(F.col("op").isNull(), kind("missing")).when(F.col("op.verb") != F.col("verb"), kind("drift", "verb")).when(F.col("op.shape") == full, kind("matched")).otherwise(kind("drift", "path"))
    named = named.select("key", verdict.alias("v"), F.when(verdict["kind"] == "matched", F.col("operation_id")).alias("operation"))
    asked = rows.where("operation_id IS NULL").select("key", "verb", "value", F.explode(F.array_distinct(F.array(full, route_shape(F.col("path"))))).alias("shape"))
    # many endpoints can ask for a route that many operations have: the operations of a route are one row, not met one by one
    by_route = ops.groupBy("verb", "shape").agg(F.count("*").alias("_n"), F.max(F.struct("path", "operation_id")).alias("_hit"))
    hits = asked.join(by_route, ["verb", "shape"], "left").groupBy("key").agg(
        F.first("value").alias("value"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.max("_hit").alias("hit"))
    guess = (
        F.when(F.col("n") > 1, kind("ambiguous")).when((F.col("n") == 1) & F.col("hit.operation_id").isNotNull(), kind("adopted")).when(F.col("n") == 1, kind("unresolved", "document-missing-operation-id"))
        .when(F.col("value").isNull(), kind("unresolved", "prefix-inconclusive")).otherwise(kind("unresolved", "no-candidate"))
    )
    unnamed = hits.select("key", guess.alias("v"), F.when(guess["kind"] == "adopted", F.col("hit.operation_id")).alias("operation"))
    return named.unionByName(unnamed).select("key", "v.kind", "v.reason", "operation")


def observe(endpoints: DataFrame, routes: DataFrame, complete: bool) -> tuple[DataFrame, DataFrame]:
    """(states, runtime_only): (key, state, reason) of endpoints (key, operation_id, method, path) against runtime routes
    (index, operation_id, method, path), and the routes that no endpoint claims."""
    seen = routes.withColumn("shape", route_shape(F.col("path")))
    by_id = seen.where("operation_id IS NOT NULL").groupBy("operation_id").agg(F.count("*").alias("ids"), F.min("index").alias("id_index"))
    by_route = seen.groupBy("method", "shape").agg(F.count("*").alias("exacts"), F.min_by(F.struct("index", "operation_id", "path"), "index").alias("route"))
    rows = endpoints.withColumn("shape", route_shape(F.col("path"))).join(by_id, "operation_id", "left").join(by_route, ["method", "shape"], "left")
    state = lambda s, reason: F.struct(F.lit(s).alias("state"), F.lit(reason).alias("reason"))
    open_ = F.col("operation_id").isNull() | F.col("method").isNull() | F.col("path").isNull()
    one = F.col("exacts") == 1
    other = one & F.col("route.operation_id").isNotNull() & (F.col("route.operation_id") != F.col("operation_id"))
    elsewhere = one & F.col("route.operation_id").isNull() & (F.col("ids") == 1) & (F.col("id_index") != F.col("route.index"))
    verdict = (
        F.when(open_, state("unknown", "source-spec-route-not-resolved")).when(F.col("ids") > 1, state("conflict", "duplicate-runtime-operation-id"))
        .when(other, state("conflict", "runtime-operation-id-conflict")).when(elsewhere, state("conflict", "runtime-operation-id-route-conflict"))
        .when(one & (F.col("route.path") == F.col("path")), state("observed", "runtime-route-exact-match")).when(one, state("observed", "runtime-route-shape-match"))
        .when(F.col("ids") == 1, state("conflict", "runtime-route-drift"))
        .otherwise(state("missing", "runtime-route-missing-from-complete-snapshot") if complete else state("unknown", "runtime-observation-partial"))
    )
    judged = rows.withColumns({"v": verdict, "many": F.col("ids") > 1, "open": open_, "one": one})
    claims_id = judged.where("NOT open AND (many OR ids = 1 AND (v.reason = 'runtime-operation-id-route-conflict' OR v.reason = 'runtime-route-drift'))").select("operation_id").distinct()
    claims_route = judged.where("NOT open AND NOT coalesce(many, false) AND one").select(F.col("route.index").alias("index")).distinct()
    only = seen.join(claims_id, "operation_id", "left_anti").join(claims_route, "index", "left_anti")
    return judged.select("key", "v.state", "v.reason"), only.drop("shape")


def state_counts(rows: DataFrame, key: str, state: str, states: list[str]) -> DataFrame:
    """One row a key with a count for each of these states, 0 where there is none."""
    return rows.groupBy(key).agg(*(F.count_if(F.col(state) == s).alias(s) for s in states))


def promotable(fields: DataFrame, key: str, field: str, required: list[str], resolved: Column) -> DataFrame:
    """Keys all of whose required fields are resolved."""
    n = F.count_distinct(F.when(resolved & F.col(field).isin(required), F.col(field)))
    return fields.groupBy(key).agg(n.alias("_n")).where(F.col("_n") == len(set(required))).select(key)
