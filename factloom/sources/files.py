"""Files and logs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listed(spark: SparkSession, root: str, include: str = "*", exclude: str | None = None) -> DataFrame:
    """(path, size, modified) of the files below root whose name fits a glob and whose path does not match a pattern, by path;
    no match is an empty table."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", include).load(root)
    rows = rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return (rows if exclude is None else rows.where(~F.col("path").rlike(exclude))).orderBy("path")


def content_index(spark: SparkSession, root: str, excluded: list[str] | None = None, most_files: int = 200_000, most_bytes: int = 2 << 30) -> DataFrame:
    """(path, size, sha256) of every file below root, folders of the excluded names left out; path is relative to root.

    It fails when there are more files or bytes than the budget, before any is read.
    """
    base = F.lit(root.rstrip("/") + "/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/")
    rows = rows.withColumn("rel", F.substring(rel, F.length(F.regexp_replace(base, r"^[a-z]+:/*", "/")) + 1, F.length(rel)))
    if excluded:
        rows = rows.where(~F.arrays_overlap(F.split("rel", "/"), F.array(*map(F.lit, excluded))))
    n = rows.agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).first()
    if n["files"] > most_files or (n["bytes"] or 0) > most_bytes:
        raise ValueError(f"{n['files']} files of {n['bytes']} bytes are over the budget")
    return rows.select(F.col("rel").alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def source_digest(index: DataFrame) -> DataFrame:
    """One row (digest): sha256 over the index in order of path; for an index that one task can hold, as its budget ensures."""
    rows = F.array_sort(F.collect_list(F.struct("path", "sha256", "size")))
    return index.agg(F.sha2(F.to_json(rows), 256).alias("digest"))


def strict_jsonl(spark: SparkSession, path: str, schema: str, valid: str, most_lines: int = 200_000, most_bytes: int = 64 << 20) -> tuple[DataFrame, int]:
    """(rows, noise) of a receipts log: lines that are no JSON objects are counted as noise; a JSON line that is not valid
    (an expression over its fields), or a log over its caps, is an error."""
    lines = spark.read.text(path).select("value", F.from_json("value", f"{schema}, _bad STRING", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    object_ = F.coalesce(F.trim("value").rlike(r"^\{.*\}$") & F.col("r._bad").isNull(), F.lit(False))
    fine = F.coalesce(F.expr(valid), F.lit(False))
    rows = lines.select("value", object_.alias("_object"), "r.*")
    n = rows.agg(F.count("*").alias("lines"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.count_if(~F.col("_object") & (F.trim("value") != "")).alias("noise"), F.count_if(F.col("_object") & ~fine).alias("bad")).first()
    if n["lines"] > most_lines or (n["bytes"] or 0) > most_bytes:
        raise ValueError("the log is over its caps")
    if n["bad"]:
        raise ValueError(f"{n['bad']} lines are not valid receipts")
    return rows.where("_object").drop("value", "_object", "_bad"), n["noise"]


def features(rows: DataFrame, archived: bool = False) -> DataFrame:
    """Feature records (feature_id, state, archived) in order of id, without corrupt, missing and (by default) archived ones."""
    fine = rows.where(F.col("feature_id").isNotNull() & F.col("state").isNotNull() & ~F.coalesce(F.col("state") == "corrupt", F.lit(False)))
    return (fine if archived else fine.where(~F.coalesce("archived", F.lit(False)))).orderBy("feature_id")


def append_events(events: DataFrame, path: str) -> None:
    """Appends to a JSON-lines log."""
    events.write.mode("append").json(path)
