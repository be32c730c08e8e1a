"""Term scoring: token matches, capped evidence, module scores and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.columns import tokens, tokens_match
from factloom.sources.tables import durable


def matches(facts: DataFrame, terms: list[str]) -> DataFrame:
    """Rows of facts (module, signal, weight, ordinal, value) for each term that matches, with term and term_ordinal."""
    given = F.explode(F.array(*(F.struct(F.lit(i).alias("term_ordinal"), F.lit(t).alias("term"), tokens(F.lit(t)).alias("want")) for i, t in enumerate(terms))))
    rows = facts.withColumn("have", tokens(F.col("value"))).select("*", given.alias("t"))
    return rows.where(tokens_match(F.col("have"), F.col("t.want"))).select("module", "signal", "weight", "ordinal", "value", "t.term", "t.term_ordinal")


def capped(found: DataFrame, cap: int = 5) -> DataFrame:
    """The first `cap` rows of each module and signal in source order, with the number there were.

    The limit goes below the shuffle and the counts are summed before it, so a signal that matches everywhere sends few rows."""
    first = F.row_number().over(Window.partitionBy("module", "signal").orderBy("ordinal", "term_ordinal"))
    few = found.withColumn("r", first).where(F.col("r") <= cap)
    return few.join(found.groupBy("module", "signal").agg(F.count("*").alias("n")), ["module", "signal"])


def scores(facts: DataFrame, terms: list[str], cap: int = 5) -> DataFrame:
    """module, score, overflowing signals and the verdict on the module."""
    kept = capped(durable(matches(facts, terms)), cap)  # matched once, read twice
    out = kept.groupBy("module").agg(F.sum("weight").cast("long").alias("score"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("n") > cap, F.col("signal")))), ",").alias("capped"))
    return out.withColumn("verdict", _verdict(F.col("score")))


def score_gap(rows: DataFrame, key: str, score: str, tie: str, least: float) -> DataFrame:
    """Best row of each key, its lead over the second, and whether that is too small to tell."""
    w = Window.partitionBy(key).orderBy(F.desc(score), tie)
    ranked = rows.withColumn("second", F.lead(score).over(w)).withColumn("r", F.row_number().over(w)).where("r = 1")
    return ranked.select(key, tie, score, (F.col(score) - F.col("second")).alias("gap")).withColumn("ambiguous", F.coalesce(F.col("gap") < least, F.lit(False)))


def top_sources(scored: DataFrame, score: str, name: str, least: int = 25, take: int = 4) -> DataFrame:
    """The `take` best rows (16 at most) of those that score `least` or more; ties to the smaller name."""
    return scored.where(F.col(score) >= least).orderBy(F.desc(score), name).limit(min(take, 16))


def combined(states: Column) -> Column:
    """One state for an array of distinct states; none at all, or null, is unknown."""
    has = lambda s: F.array_contains(states, s)
    return (
        F.when(F.coalesce(F.size(states), F.lit(0)) < 1, "unknown").when(F.size(states) == 1, F.get(states, F.lit(0)))
        .when(has("conflict"), "conflict").when(has("unknown"), "unknown").when(has("supported") & has("unsupported"), "conflict")
        .when(has("partial") | has("supported"), "partial").when(has("unsupported"), "unsupported").otherwise("not-applicable")
    )


def support_matrix(rows: DataFrame, key: str, capability: str, state: str, names: list[str]) -> DataFrame:
    """key and a column for each of these capabilities with its combined state."""
    sets = rows.groupBy(key).pivot(capability, names).agg(F.collect_set(state))
    return sets.select(key, *(combined(F.col(f"`{n}`")).alias(n) for n in names))


def populated(rows: DataFrame, names: list[str]) -> DataFrame:
    """(field, populated) for each of these columns: how many rows have a value that is not empty."""
    counts = rows.agg(*(F.count_if(F.col(c).cast("string") != "").alias(c) for c in names))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("populated")) for c in names))).alias("f")).select("f.*")


def module_verdicts(scored: DataFrame, modules: DataFrame) -> DataFrame:
    """Every module with its score, 0 and greenfield without a match, best score first and then by name."""
    rows = modules.select("module").distinct().join(scored.select("module", "score"), "module", "left").withColumn("score", F.coalesce("score", F.lit(0).cast("long")))
    return rows.withColumn("verdict", _verdict(F.col("score"))).orderBy(F.desc("score"), "module")


def overall_verdict(scored: DataFrame) -> DataFrame:
    """One row (verdict) over all modules: any collision, else any adjacent one, else greenfield."""
    return scored.agg(F.max("score").alias("m")).select(_verdict(F.coalesce("m", F.lit(0))).alias("verdict"))


def _verdict(score: Column) -> Column:
    return F.when(score >= 10, "collision").when(score > 0, "adjacent").otherwise("greenfield")


def frequencies(records: DataFrame, params: dict[str, str]) -> DataFrame:
    """(param, value, records, total, rank): how often each value of a parameter occurs, of all records; nulls are passed
    over, ranks go by count and then by value."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("param"), F.col(c).cast("string").alias("value")) for k, c in params.items())))
    n = records.select(pairs.alias("p")).select("p.*").where("value IS NOT NULL").groupBy("param", "value").agg(F.count("*").alias("records"))
    total = records.agg(F.count("*").alias("total"))  # one row
    return n.join(F.broadcast(total)).withColumn("rank", F.row_number().over(Window.partitionBy("param").orderBy(F.desc("records"), "value")))


def receipts(rows: DataFrame, current: DataFrame, trusted: Column | None = None) -> DataFrame:
    """(contract, matched, stale, unsupported, violations) of receipts (contract, contract_ref, violations: array of codes).

    Receipts of an older contract are kept and counted stale.  Violations are counted over all trusted receipts, unsupported
    ones apart; matched is counted before violations are unfolded, so that none counts twice.
    """
    own = (rows if trusted is None else rows.where(trusted)).join(current, "contract", "left")
    hit = F.col("contract_ref").eqNullSafe(F.col("current_ref"))
    odd = F.size(F.filter("violations", lambda v: v == "unsupported"))
    return own.groupBy("contract").agg(F.count_if(hit).alias("matched"), F.count_if(~hit).alias("stale"), F.sum(odd).alias("unsupported"), F.sum(F.size("violations") - odd).alias("violations"))


def operation_violations(rows: DataFrame, current: DataFrame) -> DataFrame:
    """(contract, operation, n): violations of matched receipts only, unsupported ones included."""
    own = rows.join(current, "contract").where(F.col("contract_ref") == F.col("current_ref"))
    return own.select("contract", "operation", F.explode("violations").alias("v")).groupBy("contract", "operation").agg(F.count("*").alias("n"))


def handle_audit(handles: DataFrame, snapshots: DataFrame, types: Column | None = None) -> DataFrame:
    """(handle, revoked, snapshots, last) of handles (handle, resource_type, revoked), of some types only where given."""
    taken = snapshots.groupBy("handle").agg(F.count("snapshot_id").alias("snapshots"), F.max("recorded_at").alias("last"))
    rows = handles if types is None else handles.where(F.array_contains(types, F.col("resource_type")))
    return rows.join(taken, "handle", "left").select("handle", "revoked", F.coalesce("snapshots", F.lit(0).cast("long")).alias("snapshots"), "last")


def audit_summary(audit: DataFrame) -> DataFrame:
    return audit.agg(F.count("*").alias("handles"), F.count_if("revoked").alias("revoked"), F.count_if(F.col("snapshots") == 0).alias("never"), F.coalesce(F.sum("snapshots"), F.lit(0).cast("long")).alias("snapshots"))


def outbound(changes: DataFrame, edges: DataFrame, owners: DataFrame, own: str) -> DataFrame:
    """(subject, relation, feature) of the features that a change reaches, own excluded: derives_from from its target,
    fk_references and name_collides_with from either end; owners are (node, feature)."""
    ends = lambda a, b: edges.select(F.col(a).alias("subject"), F.col(b).alias("node"), "relation")
    either = F.col("relation").isin("fk_references", "name_collides_with")
    reached = ends("target", "source").where((F.col("relation") == "derives_from") | either).unionByName(ends("source", "target").where(either))
    return changes.select("subject").distinct().join(reached, "subject").join(owners, "node").where(F.col("feature") != own).select("subject", "relation", "feature").distinct()


def dispositions(impacts: DataFrame, given: DataFrame, active: Column) -> DataFrame:
    """impacts (change_key, downstream_feature) with the mode of the first active disposition by ordinal, null without."""
    keys = ["change_key", "downstream_feature"]
    first = given.where(active).groupBy(*keys).agg(F.min_by("mode", "ordinal").alias("mode"))
    return impacts.join(first, keys, "left")


def inbound(given: DataFrame, own: str) -> DataFrame:
    """Other features' migrate dispositions that name this one."""
    return given.where((F.col("mode") == "migrate") & (F.col("downstream_feature") == own) & (F.col("feature") != own))


def dependents(declared: DataFrame, source: str) -> DataFrame:
    """(feature, n) of the features that declare a dependency on this one."""
    return declared.where(F.col("source_feature") == source).groupBy("feature").agg(F.count("*").alias("n"))


def in_order(rows: DataFrame, key: str, section: Column, *within: Column) -> DataFrame:
    """rows with ordinal, from 1: by section and the places within it."""
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy(section, *within)))
