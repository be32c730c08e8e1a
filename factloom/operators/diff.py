"""Differences between two states of a keyed table, and joins that decide by how many partners there are."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same(keys: list[str], a: str = "_a", b: str = "_b") -> Column:
    """Condition that two aliased frames agree in these columns, null equal to null; Spark can hash and sort by it."""
    return reduce(and_, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))


def _paired(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    return left.alias("_a").join(right.alias("_b"), same(keys), how)


def keyed(before: DataFrame, after: DataFrame, key: str, attrs: list[str]) -> DataFrame:
    """(key, change, attr): added and removed keys once, and each attribute that differs (null equals null)."""
    a = before.select(F.col(key).alias("k"), F.struct(*attrs).alias("a"))
    b = after.select(F.col(key).alias("k"), F.struct(*attrs).alias("b"))
    both = a.join(b, "k", "full_outer")
    each = F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.struct(F.lit("changed").alias("change"), F.lit(c).alias("attr"))) for c in attrs))
    whole = lambda how: F.array(F.struct(F.lit(how).alias("change"), F.lit("").alias("attr")))
    rows = F.when(F.col("a").isNull(), whole("added")).when(F.col("b").isNull(), whole("removed")).otherwise(F.filter(each, lambda x: x.isNotNull()))
    return both.select(F.col("k").alias(key), F.explode(rows).alias("c")).select(key, "c.*")


def set_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Distinct rows of after that are not in before."""
    return _paired(after.distinct(), before.distinct(), after.columns, "left_anti")


def table_drift(declared: DataFrame, live: DataFrame, fold: bool = True) -> DataFrame:
    """(name, status): declared only, live only; names compare without case where fold is set."""
    name = F.lower("name") if fold else F.col("name")
    a, b = declared.select(name.alias("name")).distinct(), live.select(name.alias("name")).distinct()
    both = a.withColumn("d", F.lit(True)).join(b.withColumn("l", F.lit(True)), "name", "full_outer")
    return both.where("d IS NULL OR l IS NULL").select("name", F.when(F.col("l").isNull(), "missing-live").otherwise("missing-declared").alias("status"))


def first_match(own: DataFrame, other: DataFrame, key: str, ordinal: str) -> DataFrame:
    """own with the first partner by ordinal for its key: a struct `other`."""
    firsts = other.groupBy(key).agg(F.min_by(F.struct(*other.columns), F.col(ordinal)).alias("other"))
    return own.join(firsts, key)


def cardinality(rows: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """rows with status missing, bound or ambiguous by the number of catalog entries of the key."""
    n = catalog.groupBy(key).agg(F.count("*").alias("n"))
    return rows.join(n, key, "left").withColumn("status", F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("bound")).drop("n")


def waivers(findings: DataFrame, given: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(open findings, waived findings, stale waivers) by composite key; a null in a key matches a null."""
    return _paired(findings, given, keys, "left_anti"), _paired(findings, given, keys, "left_semi"), _paired(given, findings, keys, "left_anti")


def first_wins(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """rows with `duplicate` false for the first of each key."""
    return rows.withColumn("duplicate", F.row_number().over(Window.partitionBy(key).orderBy(ordinal)) > 1)


def file_delta(before: DataFrame, after: DataFrame, key: str, attrs: list[str]) -> DataFrame:
    """(key, status): added, deleted, or modified where any attribute differs (null equals null)."""
    both = before.select(key, F.struct(*attrs).alias("a")).join(after.select(key, F.struct(*attrs).alias("b")), key, "full_outer")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    return both.select(key, status.alias("status")).where("status IS NOT NULL")


def agreement(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys in both, only left, only right; precision of left and recall against right (null without a base)."""
    both = _paired(left.select(*keys).distinct().withColumn("l", F.lit(True)), right.select(*keys).distinct().withColumn("r", F.lit(True)), keys, "full_outer")
    out = both.agg(F.count_if(F.expr("l AND r")).alias("matched"), F.count_if(F.expr("r IS NULL")).alias("only_left"), F.count_if(F.expr("l IS NULL")).alias("only_right"))
    return out.withColumns({"precision": F.try_divide(F.col("matched"), F.expr("matched + only_left")), "recall": F.try_divide(F.col("matched"), F.expr("matched + only_right"))})


def unreachable(items: DataFrame, reached: DataFrame, key: str, at: str, before: str) -> DataFrame:
    """Items that nothing reaches and that are older than a moment."""
    return items.where(F.col(at) < F.lit(before).cast("timestamp")).join(reached.select(key).distinct(), key, "left_anti")


def input_delta(before: DataFrame, after: DataFrame, key: str, inputs: str) -> DataFrame:
    """(key, name, change) of two maps of inputs; an absent name is not a null one."""
    def each(rows: DataFrame, side: str) -> DataFrame:
        return rows.select(key, F.explode(inputs).alias("name", side)).withColumn(f"has_{side}", F.lit(True))

    both = each(before, "was").join(each(after, "now"), [key, "name"], "full_outer")
    change = F.when(F.col("has_was").isNull(), "added").when(F.col("has_now").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return both.select(key, "name", change.alias("change")).where("change IS NOT NULL")


def ir_drift(left: DataFrame, right: DataFrame) -> DataFrame:
    """(schema, name, status, missing) of every left table (schema, name, columns, primary_key) against the right ones.

    Names keep their case.  No partner: table-missing; several: ambiguous; one: column-missing with the names, then
    primary-key (order counts), else same.
    """
    partners = right.groupBy("schema", "name").agg(F.count("*").alias("n"), F.first("columns").alias("other"), F.first("primary_key").alias("other_key"))
    both = left.alias("_a").join(partners.alias("_b"), same(["schema", "name"]), "left")
    missing = F.array_sort(F.array_except("columns", "other"))
    status = (
        F.when(F.col("n").isNull(), "table-missing").when(F.col("n") > 1, "ambiguous").when(F.size(missing) > 0, "column-missing")
        .when(~F.col("primary_key").eqNullSafe(F.col("other_key")), "primary-key").otherwise("same")
    )
    return both.select("_a.schema", "_a.name", status.alias("status"), F.when(F.col("n") == 1, missing).otherwise(F.array().cast("array<string>")).alias("missing"))


def planes_drift(planes: dict[str, DataFrame]) -> DataFrame:
    """ir_drift of each pair of planes, with the planes' names."""
    names = list(planes)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    return reduce(DataFrame.unionByName, (ir_drift(planes[a], planes[b]).withColumns({"left": F.lit(a), "right": F.lit(b)}) for a, b in pairs))


def policy_delta(before: DataFrame, after: DataFrame, generations: tuple[int, int]) -> DataFrame:
    """(kind, list, usage, sha256): trust that grows (allowed, or no longer revoked, or an older generation) and shrinks.

    Policies are rows (list allow or revoke, usage, sha256).
    """
    keys = ["list", "usage", "sha256"]
    came, went = set_delta(before.select(*keys), after.select(*keys)), set_delta(after.select(*keys), before.select(*keys))
    kind = lambda grows: F.when(F.col("list") == grows, "expansion").otherwise("reduction")
    out = came.withColumn("kind", kind("allow")).unionByName(went.withColumn("kind", kind("revoke")))
    if generations[1] < generations[0]:
        out = out.unionByName(before.sparkSession.createDataFrame([("generation", None, None, "expansion")], "list string, usage string, sha256 string, kind string"))
    return out


def backend_agreement(facts: DataFrame, cases: DataFrame, reference: str) -> DataFrame:
    """(backend, case_id, status) of every other backend: facts (backend, case_id, fact), cases (backend, case_id, error).

    An error on either side, or a missing side: not-comparable; else equal sets of facts agree.
    """
    lists = facts.groupBy("backend", "case_id").agg(F.array_sort(F.collect_set("fact")).alias("facts"))
    all_ = cases.join(lists, ["backend", "case_id"], "left").withColumn("facts", F.coalesce("facts", F.array().cast("array<string>")))
    base = all_.where(F.col("backend") == reference).select("case_id", F.col("error").alias("base_error"), F.col("facts").alias("base"))
    fine = F.col("error").isNull() & F.col("base_error").isNull() & F.col("base").isNotNull()
    return all_.where(F.col("backend") != reference).join(base, "case_id", "left").select(
        "backend", "case_id", F.when(~fine, "not-comparable").when(F.col("facts") == F.col("base"), "agrees").otherwise("differs").alias("status"))


def distinct_json(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each JSON form of these columns: fields that are null do not count."""
    return rows.select(*columns).withColumn("_json", F.to_json(F.struct(*columns))).dropDuplicates(["_json"]).drop("_json")
