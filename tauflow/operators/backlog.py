"""Read-only queries over a snapshot of the sender's message queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tauflow.functions.measures import retry_delay_s

# Message states, and seconds after which an unanswered message is tried again.
QUEUED, INFLIGHT = 0, 1
ACK_TIMEOUT_S = 20.0


def backlog_stats(messages: DataFrame) -> DataFrame:
    queued, inflight = F.col("status") == QUEUED, F.col("status") == INFLIGHT
    zero = F.lit(0)
    return messages.agg(
        F.count_if(queued).alias("queued"),
        F.count_if(inflight).alias("inflight"),
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.min(F.when(queued, F.col("id"))), zero).alias("next_id"),
    )


def pending_count(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("status").isin(QUEUED, INFLIGHT)).agg(F.count(F.lit(1)).alias("pending"))


def ready_messages(messages: DataFrame, now_ns: int, limit: int) -> DataFrame:
    """The first ``limit`` queued messages that are due, by id."""
    due = messages.where((F.col("status") == QUEUED) & (F.col("available_at_ns") <= now_ns))
    return due.orderBy("id").limit(limit)


def next_try_ns(now_ns: int, base_s: float = 1.0, cap_s: float = 60.0):
    return F.lit(now_ns) + (retry_delay_s(F.col("attempts"), base_s, cap_s) * 1e9).cast("bigint")


def stuck_messages(
    messages: DataFrame, now_ns: int, ack_timeout_s: float = ACK_TIMEOUT_S, base_s: float = 1.0, cap_s: float = 60.0
) -> DataFrame:
    """Messages in flight without an answer for too long, with the time they are due again."""
    waited = F.lit(now_ns) - F.col("last_attempt_ns")
    stuck = messages.where((F.col("status") == INFLIGHT) & (waited >= int(ack_timeout_s * 1e9)))
    return stuck.withColumn("next_available_ns", next_try_ns(now_ns, base_s, cap_s))
