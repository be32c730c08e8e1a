"""Reading tables, and durable intermediate tables for iterative operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reach_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver found it (a cluster ships the package itself)."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)


def tasks_for(df: DataFrame, rows: int | None = None) -> int:
    """spark.sql.shuffle.partitions; or more, if else a task had over so many rows of df on average, so that what a task sorts stays the
    same size and in memory."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(n, -(-df.count() // rows)) if rows else n


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over spark.sql.shuffle.partitions tasks (no fewer, however small it is): for rows of a few small files from
    which much is made."""
    return df.repartition(tasks_for(df), *keys)


def durable(df: DataFrame, broadcast: bool = True) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir and read again; a local folder only where that is unset and the master local.
    Spark takes a file's packed size for that of its rows: without broadcast, joins deal the table instead of sending it whole."""
    base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not df.sparkSession.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="factloom-"))
        base = _own[0]
    path = f"{base}/durable-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    return written if broadcast else written.hint("merge")


def tolerant_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected lines) of a JSON-lines log: lines that do not parse are set aside, not fatal."""
    from pyspark.sql import functions as F

    lines = spark.read.text(path).select("value", F.from_json("value", f"{schema}, _bad STRING", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = F.col("r").isNotNull() & F.col("r._bad").isNull()
    return lines.where(good).select("r.*").drop("_bad"), lines.where(~good).select("value")
