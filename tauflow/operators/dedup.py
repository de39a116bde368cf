"""Redelivered copies: keep one row, account for the others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tauflow.operators.sequence import SLICE
from tauflow.schemas import EVENT_ID


def dedup_first(
    events: DataFrame, scope: Sequence[str] = (), order: Sequence[str] = ("ts_ns",), key: Sequence[str] = EVENT_ID
) -> DataFrame:
    """Keep the earliest row of each event id; ``scope`` names columns that set runs apart.

    Rows that tie in ``order`` are told apart by a hash of all their columns, so the choice does not depend on how they are read.

    Spark limits each window group to its first row before the shuffle as well as after it, so a
    message with very many copies reaches the network once per task.
    """
    # The sequence number first: the sort then seldom looks beyond it. Where a stream was cut tells nothing of an event.
    columns = [c for c in events.columns if c != SLICE]
    w = Window.partitionBy(*reversed(key), *scope).orderBy(*order, F.xxhash64(*columns))
    return events.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") == 1).drop("_nth")


def dedup_accounting(
    arrivals: DataFrame,
    size: str = "mqtt_bytes",
    order: Sequence[str] = ("t_recv_ns",),
    key: Sequence[str] = EVENT_ID,
) -> DataFrame:
    """The first arrival of each event id, with the bytes of all its copies and how many there were."""
    rest = [c for c in arrivals.columns if c not in key and c not in order and c != size]
    first = F.min(F.struct(*order, F.col(size).alias("_size"), *rest)).alias("_first")
    return (
        arrivals.groupBy(*key)
        .agg(
            first,
            F.sum(size).alias("mqtt_size_bytes"),
            (F.count(F.lit(1)) - 1).alias("copies_dropped"),
            F.max(order[0]).alias("last_recv_ns"),
        )
        .select(
            *key,
            *[F.col(f"_first.{c}").alias(c) for c in [*order, *rest]],
            F.col("_first._size").alias("first_bytes"),
            "mqtt_size_bytes",
            "copies_dropped",
            "last_recv_ns",
            F.lit(False).alias("dup_flag"),
        )
    )


def collector_totals(accounted: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """One row over the whole collection: bytes, dropped copies, unique events, decisions, receive times."""
    totals = accounted.agg(
        F.coalesce(F.sum("mqtt_size_bytes"), F.lit(0)).alias("bytes_total_including_dups"),
        F.coalesce(F.sum("copies_dropped"), F.lit(0)).alias("dup_messages_dropped"),
        F.coalesce(F.sum(F.col("mqtt_size_bytes") - F.col("first_bytes")), F.lit(0)).alias("dup_bytes_dropped"),
        F.count(F.lit(1)).alias("events_unique"),
        F.min("t_recv_ns").alias("first_recv_ns"),
        F.max("last_recv_ns").alias("last_recv_ns"),
    )
    none = F.lit(0).cast("bigint")
    parts = totals.withColumn("decisions_count", none)
    if decisions is not None:
        decided = decisions.agg(
            F.count(F.lit(1)).alias("decisions_count"),
            F.min("t_recv_ns").alias("first_recv_ns"),
            F.max("t_recv_ns").alias("last_recv_ns"),
        )
        parts = parts.unionByName(decided, allowMissingColumns=True)
    # Two one-row results, folded into one.
    return parts.agg(
        *[F.sum(c).alias(c) for c in parts.columns if not c.endswith("_recv_ns")],
        F.min("first_recv_ns").alias("first_recv_ns"),
        F.max("last_recv_ns").alias("last_recv_ns"),
    )
