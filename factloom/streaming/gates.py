"""Gate logs and receipts as streams: the state of each gate, kept up to date batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.logs import latest


def latest_states(events: DataFrame, key: str, at: str, state: str) -> DataFrame:
    """A streaming table of the last state of each key: max_by over the stream; late events never overrule newer ones, and of
    states of one moment the greatest counts."""
    return events.groupBy(key).agg(F.max(at).alias(at), F.max_by(state, F.struct(at, state)).alias(state))


def receipt_counts(receipts: DataFrame, contract: str, ref: str, current: str) -> DataFrame:
    """matched and stale receipts of each contract.  No watermark: receipts for an older contract are late by nature and count."""
    hit = F.coalesce(F.col(ref) == current, F.lit(False))
    return receipts.groupBy(contract).agg(F.count_if(hit).alias("matched"), F.count_if(~hit).alias("stale"))


def upserts(events: DataFrame, key: str, order: list[str], states: str, history: str, checkpoint: str, on_batch: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Starts a query that appends every batch to history and writes the states after it to `states`/batch=N.

    A batch is idempotent: it is written under its own number, from the states of the batch before, so a replay after a lost
    driver or executor gives the same files.  States older than the batch before are removed.
    """
    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{history}/batch={number}")
        new = spark.read.parquet(f"{history}/batch={number}")
        if number:
            new = spark.read.parquet(f"{states}/batch={number - 1}").unionByName(new)
        latest(new, key, *order).write.mode("overwrite").parquet(f"{states}/batch={number}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{states}/batch={number - 2}")
        old.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(old, True)
        if on_batch:
            on_batch(spark.read.parquet(f"{states}/batch={number}"))

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
