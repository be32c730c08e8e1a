"""Trust, certification and readiness: rule tables over evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def artifact_trust(artifacts: DataFrame, allowed: DataFrame, revoked: DataFrame) -> DataFrame:
    """artifacts (usage, sha256) with trust: revoked by digest, whatever the usage, before allowed by both, else untrusted."""
    no = revoked.select("sha256").distinct().withColumn("_no", F.lit(True))
    yes = allowed.select("usage", "sha256").distinct().withColumn("_yes", F.lit(True))
    rows = artifacts.join(no, "sha256", "left").join(yes, ["usage", "sha256"], "left")
    return rows.withColumn("trust", F.when(F.col("_no"), "revoked").when(F.col("_yes"), "allowed").otherwise("untrusted")).drop("_no", "_yes")


def evaluated(expected: DataFrame, results: DataFrame) -> DataFrame:
    """(layer, case_id, status) of expected cases (layer, case_id) and results (layer, case_id, passed, verified): missing,
    unknown, duplicate, unverified, failed or passed."""
    got = results.groupBy("layer", "case_id").agg(F.count("*").alias("n"), F.bool_and("passed").alias("passed"), F.bool_and("verified").alias("verified"))
    rows = expected.select("layer", "case_id").distinct().withColumn("expected", F.lit(True)).join(got, ["layer", "case_id"], "full_outer")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("expected").isNull(), "unknown").when(F.col("n") > 1, "duplicate").when(~F.col("verified"), "unverified").when(~F.col("passed"), "failed").otherwise("passed")
    return rows.select("layer", "case_id", status.alias("status"))


def ready(statuses: DataFrame, key: str, status: str = "status", good: str = "passed") -> DataFrame:
    """(key, ready, blockers): ready where nothing but the good status occurs; the other statuses by name."""
    return statuses.groupBy(key).agg(F.bool_and(F.col(status) == good).alias("ready"), F.array_join(F.array_sort(F.collect_set(F.when(F.col(status) != good, F.col(status)))), ",").alias("blockers"))


def duplicate_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of the keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def certified(evidence: DataFrame, key: str, kind: str, levels: dict[str, list[str]]) -> DataFrame:
    """(key, level): the last of the levels, each of which needs all its kinds of evidence and those of the ones before."""
    have = evidence.groupBy(key).agg(F.collect_set(kind).alias("have"))  # a set of kinds, few whatever the rows
    level, need = F.lit("none"), []
    for name, kinds in levels.items():
        need = [*need, *kinds]
        level = F.when(F.size(F.array_except(F.array(*map(F.lit, need)), F.col("have"))) == 0, name).otherwise(level)
    return have.select(key, level.alias("level"))


def checks_pass(required: DataFrame, observed: DataFrame, evidence: DataFrame) -> DataFrame:
    """(release, blockers) of required checks (release, check_id, required): each must be required and observed PASS with
    evidence that resolves, in every one of its observations; codes are distinct and sorted."""
    seen = observed.join(evidence.select("ref").distinct().withColumn("_there", F.lit(True)), "ref", "left")
    all_ = lambda c: F.bool_and(F.coalesce(c, F.lit(False)))
    each = seen.groupBy("check_id").agg(all_(F.col("result") == "PASS").alias("_pass"), all_(F.col("_there")).alias("_held"))
    rows = required.join(each, "check_id", "left")
    passed = F.coalesce((F.col("required") == "PASS") & F.col("_pass"), F.lit(False))
    code = F.when(~passed, "check-not-passed").when(~F.col("_held"), "evidence-missing")
    return rows.groupBy("release").agg(F.array_join(F.array_sort(F.collect_set(code)), ",").alias("blockers"))


def capability_allowed(needs: DataFrame, have: DataFrame, allowed: Column) -> DataFrame:
    """needs (adapter, capability) with status, whether it is allowed and, if not, the reason; a missing or unknown one never
    is, nor is one whose records differ (their status is unknown)."""
    one = have.groupBy("adapter", "capability").agg(F.min(F.coalesce("status", F.lit("unknown"))).alias("_lo"), F.max(F.coalesce("status", F.lit("unknown"))).alias("_hi"))
    rows = needs.join(one, ["adapter", "capability"], "left")
    same = F.col("_lo") == F.col("_hi")
    status = F.when(same, F.col("_lo")).otherwise("unknown")
    ok = (status != "unknown") & F.array_contains(allowed, status)
    # The reasons.
    reason = F.when(F.col("_lo").isNull(), "capability record is missing").when(~same, "capability records conflict").when(
        ~ok, F.concat(F.lit("status "), status, F.lit(" is not accepted by this policy")))
    return rows.withColumns({"status": status, "allowed": ok, "reason": reason}).drop("_lo", "_hi")


#: Failure codes that no waiver may cover.
NON_WAIVABLE = ("identity.hash-mismatch", "trust.sandbox-escape", "trust.secret-leak", "evidence.replay", "contract.unknown-major")


def waiver_reason(code: Column, subject: Column, scope: Column, codes: Column, expires: Column, now: Column) -> Column:
    """The first reason against a waiver (scope, codes, expires; without a scope there is none) for a failure code of a
    subject; null if it is allowed.  A moment that can't be read allows nothing."""
    never = F.array(*map(F.lit, NON_WAIVABLE))
    at = F.try_to_timestamp(expires)
    # The reasons.
    return (
        F.when(F.array_contains(never, code), F.concat(code, F.lit(" is non-waivable")))
        .when(scope.isNull(), "no waiver supplied")
        .when(~scope.eqNullSafe(subject), F.concat(F.lit("waiver scope "), scope, F.lit(" does not match subject "), F.coalesce(subject, F.lit(""))))
        .when(~F.coalesce(F.array_contains(codes, code), F.lit(False)), F.concat(F.lit("waiver does not cover "), F.coalesce(code, F.lit(""))))
        .when(F.arrays_overlap(codes, never), "waiver attempts to cover a non-waivable failure code")
        .when(at.isNull(), "waiver.expiresAt must be a valid date-time")
        .when(at <= now, "waiver is expired")
    )


def inventory_faults(baseline: DataFrame, found: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, fault): missing, unexpected or changed against a baseline of digests."""
    a, b = baseline.select(key, F.col(digest).alias("_a"), F.lit(True).alias("_in")), found.select(key, F.col(digest).alias("_b"), F.lit(True).alias("_out"))
    fault = F.when(F.col("_out").isNull(), "missing").when(F.col("_in").isNull(), "unexpected").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full_outer").select(key, fault.alias("fault")).where("fault IS NOT NULL")


def root_expansions(before: DataFrame, after: DataFrame, root: str, ancestors) -> DataFrame:
    """Roots granted after that no root granted before contains."""
    new = after.select(root).distinct()
    up = new.select(F.col(root).alias("_root"), F.explode(F.array_append(ancestors(F.col(root)), F.col(root))).alias(root))
    covered = up.join(before.select(root).distinct(), root, "left_semi").select(F.col("_root").alias(root))
    return new.join(covered, root, "left_anti")
