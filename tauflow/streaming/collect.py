"""The collector as streaming queries: route, decode, drop copies, keep account, write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tauflow.operators.dedup import dedup_accounting
from tauflow.schemas import EVENT_ID, MESSAGE

# Fixed value: seconds between two flushes of the collector.
FLUSH_INTERVAL_S = 10
BATCH = "batch_id"


def message_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Messages as they land in a folder of Parquet files; a Kafka source serves with the same columns."""
    reader = spark.readStream.schema(MESSAGE)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stream_dedup(events: DataFrame, lateness: str | None = None) -> DataFrame:
    """First arrival of each event id.

    Without ``lateness`` every id is remembered for good: exact, and state grows with the number of
    events. With it (for example "1 hour"), ids are forgotten that long after their event time, which
    bounds the state and is exact as long as no copy comes later than that.
    """
    if lateness is None:
        return events.dropDuplicates(list(EVENT_ID))
    timed = events.withColumn("event_time", event_times())
    return timed.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(list(EVENT_ID)).drop("event_time")


def stream_dedup_accounting(arrivals: DataFrame, size: str = "mqtt_bytes") -> DataFrame:
    """First arrival, bytes over all copies and copies dropped per event id, kept up to date."""
    return dedup_accounting(arrivals, size, order=("t_recv_ns",))


def event_times() -> Column:
    return F.timestamp_micros((F.col("ts_ns") / 1000).cast("bigint"))


def stream_final_accounts(arrivals: DataFrame, lateness: str, size: str = "mqtt_bytes") -> DataFrame:
    """The account of each event id, given out once and then forgotten: when an event ``lateness`` newer has come.

    State holds the ids of the newest ``lateness`` of event time only. Copies that come later than that are left out, as
    are the accounts of that newest stretch until the stream goes on; copies carry the time of their event. Spark's watermark starts
    at 1970, so events of before count as late. For output mode "append".
    """
    timed = arrivals.withColumn("event_time", event_times()).withWatermark("event_time", lateness)
    return dedup_accounting(timed, size, order=("t_recv_ns",), key=(*EVENT_ID, "event_time")).drop("event_time")


def _trigger(writer, flush_s: float | None):
    # One bounded run over what is there, or a flush every so many seconds.
    return writer.trigger(availableNow=True) if flush_s is None else writer.trigger(processingTime=f"{flush_s} seconds")


def write_log_stream(rows: DataFrame, path: str, checkpoint: str, flush_s: float | None = FLUSH_INTERVAL_S) -> StreamingQuery:
    """Append to a Parquet log; the checkpoint makes a restart neither lose nor repeat rows."""
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return _trigger(writer.outputMode("append"), flush_s).start()


def write_accounting_stream(
    accounts: DataFrame, path: str, checkpoint: str, flush_s: float | None = FLUSH_INTERVAL_S
) -> StreamingQuery:
    """Write each batch's changed accounts below ``path``; a repeated batch overwrites its own directory."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    writer = accounts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return _trigger(writer, flush_s).start()


def latest_accounts(spark: SparkSession, path: str, keys: Sequence[str] = EVENT_ID) -> DataFrame:
    """Newest state of each account (or of what else has ``keys``) from what ``write_accounting_stream`` has written."""
    w = Window.partitionBy(*keys).orderBy(F.col(BATCH).desc())
    accounts = spark.read.parquet(path)
    return accounts.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") == 1).drop("_nth", BATCH)
