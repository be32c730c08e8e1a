"""Collisions between features, foreign keys across them, and the database catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resources(rows: DataFrame, feature: str, name: str, ordinal: str) -> DataFrame:
    """(feature, ordinal, name, other_feature, other_ordinal): each resource with the first one of its name in each other
    feature; names keep their case."""
    firsts = rows.groupBy(F.col(name), F.col(feature).alias("other_feature")).agg(F.min(ordinal).alias("other_ordinal"))
    return rows.select(feature, ordinal, name).join(firsts, name).where(F.col(feature) != F.col("other_feature"))


def tables(rows: DataFrame, feature: str, table: str, ordinal: str, explicit: Column) -> DataFrame:
    """Like resources for lower-case table names that are not empty, with confidence: high where both sides are explicit."""
    named = rows.select(feature, ordinal, F.lower(table).alias("table"), explicit.alias("explicit")).where("table <> ''")
    firsts = named.groupBy("table", F.col(feature).alias("other_feature")).agg(F.min_by(F.struct(F.col(ordinal).alias("ordinal"), "explicit"), F.col(ordinal)).alias("o"))
    both = named.join(firsts, "table").where(F.col(feature) != F.col("other_feature"))
    return both.select(feature, ordinal, "table", "other_feature", F.col("o.ordinal").alias("other_ordinal"), F.when(F.col("explicit") & F.col("o.explicit"), "high").otherwise("low").alias("confidence"))


def operations(rows: DataFrame, feature: str, operation: str) -> DataFrame:
    """(feature, operation, other_feature) of operation ids that another feature has too."""
    ids = rows.where(F.col(operation).isNotNull()).select(feature, operation).distinct()
    return ids.join(ids.withColumnRenamed(feature, "other_feature"), operation).where(F.col(feature) != F.col("other_feature"))


def fk_edges(fks: DataFrame, own: DataFrame, other: DataFrame) -> DataFrame:
    """(child, parent, relation, feature) of foreign keys between own tables and those of other features.

    Tables compare in lower case; of other tables with one name the last by ordinal counts.
    """
    mine = own.select(F.lower("table").alias("t")).distinct()
    last = other.groupBy(F.lower("table").alias("t")).agg(F.max_by("feature", "ordinal").alias("feature"))

    def side(a: str, b: str, relation: str) -> DataFrame:
        return fks.join(mine, F.lower(a) == F.col("t"), "left_semi").join(last, F.lower(b) == F.col("t")).select("child", "parent", F.lit(relation).alias("relation"), "feature")

    return side("child", "parent", "references").unionByName(side("parent", "child", "referenced_by"))


def fk_unknown(fks: DataFrame, own: DataFrame, other: DataFrame) -> DataFrame:
    """(child, parent, unknown): foreign keys with one own side whose other side belongs to nobody; the child's side first."""
    def marked(rows: DataFrame, tables: DataFrame, column: str, flag: str) -> DataFrame:
        known = tables.select(F.lower("table").alias("_t")).distinct().withColumn(flag, F.lit(True))
        return rows.join(known, F.lower(column) == F.col("_t"), "left").drop("_t")

    rows = fks
    for tables_, column, flag in ((own, "child", "c_own"), (own, "parent", "p_own"), (other, "child", "c_other"), (other, "parent", "p_other")):
        rows = marked(rows, tables_, column, flag)
    unknown = F.when(F.col("c_own") & F.col("p_own").isNull() & F.col("p_other").isNull(), F.col("parent")).when(F.col("p_own") & F.col("c_own").isNull() & F.col("c_other").isNull(), F.col("child"))
    return rows.select("child", "parent", unknown.alias("unknown")).where("unknown IS NOT NULL")


def catalog_keys(constraints: DataFrame, usage: DataFrame, kind: str, referenced: DataFrame | None = None) -> DataFrame:
    """Key columns of constraints of a kind; with `referenced`, each with each referenced column: a key over n columns has
    n times n rows, as the catalog's own views give them."""
    on = ["constraint_name", "table_schema"]
    rows = constraints.where(F.col("constraint_type") == kind).join(usage, on)
    if referenced is not None:
        rows = rows.join(referenced.select(*on, F.col("table_name").alias("references_table"), F.col("column_name").alias("references_column")), on)
    return rows


def assembled(tables_: DataFrame, key: str, lists: dict[str, DataFrame]) -> DataFrame:
    """tables with one sorted array of structs for each named list of rows; none is an empty array."""
    for name, rows in lists.items():
        rest = [c for c in rows.columns if c != key]
        kind = rows.select(F.struct(*rest).alias("x")).schema["x"].dataType.simpleString()
        tables_ = tables_.join(rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.array().cast(f"array<{kind}>")))
    return tables_


def merged_tables(parts: DataFrame) -> DataFrame:
    """(name, columns, relations, files) of tables (name, columns, relations, file) that several files describe."""
    each = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return parts.groupBy("name").agg(each("columns"), F.array_sort(F.flatten(F.collect_list("relations"))).alias("relations"), F.array_sort(F.collect_set("file")).alias("files"))


def relation_groups(fks: DataFrame) -> DataFrame:
    """(table, parent, columns, pairing): a pair of tables with one row is resolved, with more ambiguous."""
    out = fks.groupBy("table", "parent").agg(F.array_sort(F.collect_set("column")).alias("columns"), F.count("*").alias("n"))
    return out.select("table", "parent", "columns", F.when(F.col("n") == 1, "resolved").otherwise("ambiguous").alias("pairing"))


def erd_relationships(fks: DataFrame, columns: DataFrame, keys: DataFrame, live: bool = True) -> DataFrame:
    """(child, parent, label, cardinality, identifying, external) for the lines of an entity diagram.

    fks (child, parent, column, references_column), columns (table, column, nullable), keys (table, column).  Foreign keys of
    one column stay apart; where a pair's keys reach two columns and more of the parent the pair is one line.
    """
    n = fks.groupBy("child", "parent").agg(F.count_distinct("references_column").alias("targets"), F.array_join(F.array_sort(F.collect_set("column")), "+").alias("all"))
    rows = fks.join(n, ["child", "parent"])
    single = rows.where("targets < 2").select("child", "parent", F.col("column").alias("label"), "column").distinct()
    joint = rows.where("targets >= 2").select("child", "parent", F.col("all").alias("label"), F.lit(None).cast("string").alias("column")).distinct()
    own = columns.select(F.col("table").alias("child"), "column", "nullable")
    key = keys.select(F.col("table").alias("child"), "column", F.lit(True).alias("in_key"))
    known = columns.select(F.col("table").alias("parent")).distinct().withColumn("known", F.lit(True))
    lines = single.unionByName(joint).join(own, ["child", "column"], "left").join(key, ["child", "column"], "left").join(known, "parent", "left")
    return lines.select("child", "parent", "label", F.when(F.lit(live) & ~F.coalesce("nullable", F.lit(True)), "||").otherwise("|o").alias("cardinality"),
                        (F.lit(live) & F.coalesce("in_key", F.lit(False))).alias("identifying"), F.col("known").isNull().alias("external"))
