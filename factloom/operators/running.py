"""Running sums over keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.tables import durable


def running_sums(rows: DataFrame, key: str, order: str, sums: dict[str, Column]) -> DataFrame:
    """rows with the sums, by name, of a column over the rows of their key up to each one in order (which tells rows of a key apart).

    Rows are sorted by ranges of key and order, so a key with most of them is the work of many tasks: each range sums its own
    rows, the sums of the ranges before (a row for each key and range) are added."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = durable(rows.withColumns({f"_{name}": c for name, c in sums.items()}).repartitionByRange(n, key, order).withColumn("_range", F.spark_partition_id()))
    parts = placed.groupBy(key, "_range").agg(*(F.sum(f"_{name}").alias(f"_{name}") for name in sums))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(key).alias("_key"), F.col("_range").alias("_at"), *(F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_before_{name}") for name in sums))
    here = Window.partitionBy(key, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(parts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_at")))
    out = joined.withColumns({name: F.col(f"_before_{name}") + F.coalesce(F.sum(f"_{name}").over(here), F.lit(0)) for name in sums})
    return out.select(*rows.columns, *sums)
