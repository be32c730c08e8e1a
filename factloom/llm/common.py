"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parents[2])
_own_dir: list[str] = []
_paths: dict[int, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local one only where that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="factloom-"))
    return _own_dir[0]


#: Rows of a batch that a Python task holds at a time: whole texts are long.
_BATCH_ROWS = 2048
_lean = {"lock": threading.Lock(), "users": 0, "before": {}}


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """For the actions inside, Spark deletes an action's shuffle files as soon as it has ended, as its output no longer needs
    them, and hands Python tasks smaller batches.  The settings are the session's; the last thread inside puts them back."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    with _lean["lock"]:
        if not _lean["users"]:
            most = int(spark.conf.get(rows))
            wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", rows: str(min(most, _BATCH_ROWS) if most > 0 else _BATCH_ROWS)}
            _lean["before"] = {k: spark.conf.get(k) for k in wanted}
            for k, v in wanted.items():
                spark.conf.set(k, v)
        _lean["users"] += 1
    try:
        yield
    finally:
        with _lean["lock"]:
            _lean["users"] -= 1
            if not _lean["users"]:
                for k, v in _lean["before"].items():
                    spark.conf.set(k, v)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and survives the loss of any executor."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    with lean(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path, weakref.finalize(out, _paths.pop, id(out), None)
    if (made := getattr(_stage, "made", None)) is not None:
        made.append(path)
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() returned; nothing that is still to run may read them."""
    for table_ in tables:
        delete(table_.sparkSession, _paths.pop(id(table_))[0])


_stage = threading.local()


@contextmanager
def stage_tables(spark: SparkSession) -> Iterator[None]:
    """A stage of a pipeline.  Its output is written before this thread enters the next one, so what written() made inside is
    deleted then (or by cleared())."""
    cleared(spark)
    _stage.made = []
    try:
        yield
    finally:
        _stage.left, _stage.made = _stage.made, None


def cleared(spark: SparkSession) -> None:
    """Deletes the tables of this thread's last stage."""
    for path in getattr(_stage, "left", ()):
        delete(spark, path)
    _stage.left = []


_BITS = 1 << 24


def sieved(rows: DataFrame, key: str, some: DataFrame, some_key: str) -> DataFrame:
    """rows with `hit`: false where key is surely not among some_key.  A bitmap of _BITS bits is broadcast (at most _BITS / 64
    rows, whatever the input), so that rows without a partner need no shuffle."""
    spot = lambda c: F.shiftright(F.pmod(F.xxhash64(c), F.lit(_BITS)), 6)
    bit = lambda c: F.expr(f"shiftleft(1L, cast(pmod(xxhash64({c}), 64) AS INT))")
    bits = F.broadcast(some.select(spot(some_key).alias("_w"), bit(some_key).alias("_b")).groupBy("_w").agg(F.bit_or("_b").alias("_b")))
    return rows.join(bits, spot(key) == F.col("_w"), "left").withColumn("hit", F.coalesce(F.col("_b").bitwiseAND(bit(key)) != 0, F.lit(False))).drop("_w", "_b")


def id_text():
    """doc_id as text, for frames that Python reads: pandas makes doubles of whole numbers beside nulls, and ids over 2 ** 53 others."""
    return F.col("doc_id").cast("long").cast("string").alias("doc_id")


def with_ids(df: DataFrame) -> DataFrame:
    """df with doc_id as a number again."""
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


def parts(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def reach_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver found it (a cluster ships the package itself)."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if _ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, have) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_crc(column: str = "doc_id"):
    """crc32 of an id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


#: Characters of text in a sample of labelled rows.
SAMPLE_CHARS = 1 << 24


def labelled_sample(docs: DataFrame, label: DataFrame, most: int, chars: int = SAMPLE_CHARS) -> DataFrame:
    """At most `most` labelled documents of at most `chars` characters together, with their whole texts, one row an id.

    They are picked by a hash of doc_id among the ids that both tables hold.  Of several labels of an id the least counts,
    of several texts the least.  The bounds make the sample small enough to train on in one process.
    """
    values = [c for c in label.columns if c != "doc_id"]
    one = label.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(*values)).alias("label"))
    sizes = docs.where("doc_id IS NOT NULL").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("size")).join(one, "doc_id")
    by = [F.xxhash64("doc_id"), F.col("doc_id")]
    few = sizes.groupBy("doc_id").agg(F.max("size").alias("size"), F.first("label").alias("label")).orderBy(*by).limit(most)
    used = F.sum("size").over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))  # of `most` rows
    few = few.withColumn("used", used).where(F.col("used") <= chars).select("doc_id", "label.*")
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id", *values).agg(F.min("text").alias("text"))
