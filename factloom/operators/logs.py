"""Ordered logs: latest state, freshness, chains, fencing and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.running import running_sums


def latest(log: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key, by partial aggregation."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def event_type(awaiting: Column, revoked: Column, forced: Column) -> Column:
    """awaiting, revoke, force or pass, the first that holds."""
    return F.when(awaiting, "awaiting").when(revoked, "revoke").when(forced, "force").otherwise("pass")


def gate_status(now: Column, at: Column, event: Column, minutes: Column | int, changed: Column | None = None) -> Column:
    """not_run (no event), awaiting, revoked, stale (inputs changed, or too old), forced or pass, the first that holds.

    Age counts whole seconds, the future as 0; a moment that cannot be read is too old; 0 minutes switch the limit off.
    """
    limit = F.lit(minutes) if isinstance(minutes, int) else minutes
    age = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(at))
    old = (limit > 0) & (at.isNull() | (age > 60 * limit))
    stale = old if changed is None else F.coalesce(changed, F.lit(False)) | old
    return F.when(event.isNull(), "not_run").when(event == "awaiting", "awaiting").when(event == "revoke", "revoked").when(stale, "stale").when(event == "force", "forced").otherwise("pass")


def audit_chain(log: DataFrame, key: str, seq: str, genesis: str, body: Column) -> DataFrame:
    """log (with sha256 and prev_sha256) and linked, own, contiguous: prev is the last digest before, or the genesis seed;
    the digest is that of prev and body; seq counts from 1.  An entry without a digest carries the one before it on."""
    w = Window.partitionBy(key).orderBy(seq)
    before = F.coalesce(F.last("sha256", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(genesis))
    own = F.coalesce(F.col("sha256") == F.sha2(F.concat("prev_sha256", body), 256), F.lit(False))
    return log.withColumns({"linked": F.col("prev_sha256").eqNullSafe(before), "own": own, "contiguous": F.col(seq) == F.row_number().over(w)})


def outcome_faults(decisions: DataFrame, outcomes: DataFrame, key: str, seq: str) -> DataFrame:
    """outcomes with fault: duplicate for all but a decision's first, orphan without a decision, else null."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(seq))
    known = decisions.select(key).distinct().withColumn("known", F.lit(True))
    rows = outcomes.withColumn("nth", nth).join(known, key, "left")
    return rows.withColumn("fault", F.when(F.col("known").isNull(), "orphan").when(F.col("nth") > 1, "duplicate")).drop("nth", "known")


def gc_prefix(blobs: DataFrame, group: str, order: str, size: str, most: int, most_bytes: int) -> DataFrame:
    """Candidates in order up to the first that breaks the cap on their number or bytes (sizes are not negative)."""
    placed = running_sums(blobs, group, order, {"nth": F.lit(1).cast("long"), "used": F.col(size)})
    return placed.where((F.col("nth") <= most) & (F.col("used") <= most_bytes))


def skip_budget(sources: DataFrame, key: str, order: str, size: str, limit: int, most: int = 100) -> DataFrame:
    """(key, order, included, refused): the sources of a request in order, included where they fit beside the ones included
    before, those that do not passed over.  A request of more than `most` sources is refused as a whole: one row without
    an order.  No list is longer than that."""
    few = sources.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_n") <= most + 1)
    lists = few.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("_n"), F.col(order).alias("o"), F.col(size).cast("double").alias("z")))).alias("s"))
    kind = f"array<struct<o:{dict(sources.dtypes)[order]},included:boolean>>"
    fits = lambda acc, x: acc["used"] + x["z"] <= limit
    fold = F.aggregate("s", F.struct(F.lit(0.0).alias("used"), F.array().cast(kind).alias("out")), lambda acc, x: F.struct(
        F.when(fits(acc, x), acc["used"] + x["z"]).otherwise(acc["used"]).alias("used"),
        F.array_append(acc["out"], F.struct(x["o"].alias("o"), F.coalesce(fits(acc, x), F.lit(False)).alias("included"))).alias("out")))
    refused = F.size("s") > most
    none = F.array(F.struct(F.lit(None).alias("o"), F.lit(False).alias("included"))).cast(kind)
    told = lists.select(key, refused.alias("refused"), F.explode(F.when(refused, none).otherwise(fold["out"])).alias("x"))
    return told.select(key, F.col("x.o").alias(order), "x.included", "refused")


def arbitrate(claims: DataFrame, key: str, name: str, specificity: str) -> DataFrame:
    """(key, winner, tied): the claim of the greatest specificity; a tie has no winner and names all."""
    top = claims.groupBy(key).agg(F.max(specificity).alias("_m"))
    best = claims.join(top, key).where(F.col(specificity) == F.col("_m")).groupBy(key).agg(F.array_sort(F.collect_set(name)).alias("names"))
    alone = F.size("names") == 1
    return best.select(key, F.when(alone, F.get("names", F.lit(0))).alias("winner"), F.when(~alone, F.array_join("names", ",")).alias("tied"))


def gate_verdict(gates: DataFrame, key: str, gate: str, status: str, blocking: Column) -> DataFrame:
    """(key, blocking, passing, total, ok): blocking gates by name, passing ones with forced ones."""
    out = gates.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.when(blocking, F.col(gate)))), ",").alias("blocking"), F.count_if(F.col(status).isin("pass", "forced")).alias("passing"), F.count("*").alias("total"))
    return out.withColumn("ok", F.col("blocking") == "")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], withdrawn: Column | None = None) -> DataFrame:
    """old with new in place of rows of the same keys; rows of new that withdraw leave nothing."""
    kept = old.join(new.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(new if withdrawn is None else new.where(~withdrawn))


def evicted(cache: DataFrame, key: str, deps: str, changed: DataFrame) -> DataFrame:
    """Keys of cache entries that depend on a changed input (one column)."""
    each = cache.select(key, F.explode(deps).alias(changed.columns[0]))
    return each.join(changed.distinct(), changed.columns[0], "left_semi").select(key).distinct()


def ci_selection(changed: DataFrame, active: DataFrame, feature: Column, documentation: Column) -> DataFrame:
    """(feature_id, reason): all active features for a change that belongs to none and is no document, else those touched."""
    rows = changed.select(feature.alias("feature_id"), documentation.alias("doc")).join(active.select("feature_id").distinct().withColumn("known", F.lit(True)), "feature_id", "left")
    shared = rows.agg(F.coalesce(F.bool_or(F.col("known").isNull() & ~F.col("doc")), F.lit(False)).alias("shared"))
    touched = rows.where("known").select("feature_id").distinct().withColumn("touched", F.lit(True))
    out = active.select("feature_id").distinct().join(touched, "feature_id", "left").join(F.broadcast(shared))
    return out.where("shared OR touched").select("feature_id", F.when(F.col("shared"), "shared_product_change_all_active").otherwise("feature_scoped_changes").alias("reason"))


def performance_gate(base: DataFrame, candidate: DataFrame, least: int = 5, most_pct: float = 15.0, cached: float = 0.5) -> DataFrame:
    """(id, status, code) of every workload (id, samples, cold, rss, hit): blocked before fail before pass."""
    side = lambda rows, n: rows.select("id", *(F.col(c).alias(f"{n}_{c}") for c in ("samples", "cold", "rss", "hit")))
    both = side(base, "b").join(side(candidate, "c"), "id", "full_outer")
    grown = lambda c: F.try_divide((F.col(f"c_{c}") - F.col(f"b_{c}")) * 100, F.col(f"b_{c}")) > most_pct
    code = (
        F.when(F.col("b_samples").isNull() | F.col("c_samples").isNull(), "WORKLOAD_SET_MISMATCH").when(F.least("b_samples", "c_samples") < least, "INSUFFICIENT_SAMPLES")
        .when(grown("cold"), "COLD_REGRESSION").when(grown("rss"), "RSS_REGRESSION").when(F.try_divide("c_hit", "c_cold") > cached, "CACHE_HIT_TOO_SLOW")
    )
    out = both.select("id", code.alias("code"))
    return out.select("id", F.when(F.col("code").isin("WORKLOAD_SET_MISMATCH", "INSUFFICIENT_SAMPLES"), "blocked").when(F.col("code").isNotNull(), "fail").otherwise("pass").alias("status"), "code")


def chain_breaks(log: DataFrame, key: str, seq: str, digest: str, prev: str) -> DataFrame:
    """log with `linked` (prev is the digest before, or null at the start) and `contiguous` (seq follows on)."""
    w = Window.partitionBy(key).orderBy(seq)
    return log.withColumn("linked", F.col(prev).eqNullSafe(F.lag(digest).over(w))).withColumn("contiguous", F.coalesce(F.col(seq) - F.lag(seq).over(w) == 1, F.lit(True)))


def fencing_faults(log: DataFrame, key: str, seq: str, token: str) -> DataFrame:
    """Rows whose token does not exceed every earlier one of the key."""
    before = F.max(token).over(Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1))
    return log.withColumn("highest", before).where(F.col(token) <= F.col("highest"))


def prefix_budget(files: DataFrame, key: str, order: str, size: str, limit: int, oversize: int) -> DataFrame:
    """Files in order until the first that does not fit; oversize ones are passed over and use up nothing."""
    placed = running_sums(files, key, order, {"used": F.when(F.col(size) <= oversize, F.col(size)).otherwise(0)})
    # sizes are not negative, so the running sum exceeds the limit from the first misfit on
    return placed.where((F.col(size) <= oversize) & (F.col("used") <= limit))


def kind_counts(log: DataFrame, kind: str, kinds: list[str]) -> DataFrame:
    """Number of rows of each of these kinds, 0 where there is none; other kinds are left out."""
    given = log.sparkSession.createDataFrame([(k,) for k in kinds], f"{kind} string")
    n = log.groupBy(kind).agg(F.count("*").alias("n"))
    return given.join(n, kind, "left").select(kind, F.coalesce("n", F.lit(0)).alias("n"))


def forbidden_moves(log: DataFrame, key: str, order: list[str], state: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """log with `was`, only where a state follows another one and the move is not allowed."""
    moved = log.withColumn("was", F.lag(state).over(Window.partitionBy(key).orderBy(*order)))
    fine = F.concat_ws(">", "was", state).isin([">".join(m) for m in allowed])
    return moved.where(F.col("was").isNotNull() & (F.col("was") != F.col(state)) & ~fine)


def mode_faults(log: DataFrame, key: str, order: list[str], mode: str) -> DataFrame:
    """Rows whose mode is not that of the first row of their log."""
    first = log.groupBy(key).agg(F.min_by(mode, F.struct(*order)).alias("bound"))
    return log.join(first, key).where(F.col(mode) != F.col("bound"))


def first_blocking(gates: DataFrame, key: str, gate: str, ordinal: str, blocking: Column) -> DataFrame:
    """(key, gate): the first blocking gate in gate order, ties to the smaller name; null where none blocks."""
    return gates.groupBy(key).agg(F.min_by(gate, F.when(blocking, F.struct(ordinal, gate))).alias(gate))


def contract_class(rows: DataFrame, key: str, error: Column) -> DataFrame:
    """(key, class): blocked without operations, partial with any error, else complete; a null error marks no operation."""
    n = rows.groupBy(key).agg(F.count(error).alias("n"), F.coalesce(F.bool_or(error), F.lit(False)).alias("bad"))
    return n.select(key, F.when(F.col("n") == 0, "blocked").when(F.col("bad"), "partial").otherwise("complete").alias("class"))
