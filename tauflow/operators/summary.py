"""Scenario summary: byte rate, Age of Information and residual per profile, policy and sensor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tauflow.functions.measures import NAN, bytes_per_second, skip_nan
from tauflow.operators import aoi
from tauflow.operators.dedup import dedup_first
from tauflow.operators.packets import with_event_bytes
from tauflow.operators.ranks import exact_percentile
from tauflow.operators.sequence import MAX_ROWS, partition_keys
from tauflow.schemas import POLICIES, SCENARIO
from tauflow.session import staged

def summarize(
    events: DataFrame,
    scope: Sequence[str] = ("profile", "policy"),
    group: Sequence[str] = SCENARIO,
    order: Sequence[str] = ("ts_ns",),
    max_rows: int | None = MAX_ROWS,
    deduplicated: bool = False,
) -> DataFrame:
    """One row per scenario. Gaps are taken per device inside a scenario and pooled.

    Copies are dropped and bytes worked out once, into a narrow work table; totals, gaps and residuals
    then scan only their own columns of it. Gaps are worked out once, too. Events that come with their slices
    (``_slice``, in order of time within each stream) are not cut again.
    """
    present = events.dropna(subset=list(group))
    unique = present if deduplicated else dedup_first(present, scope, order)
    stream = [*group, "device_id"]
    rows = staged(
        with_event_bytes(unique).select(
            *partition_keys(events, stream), "ts_ns", "kbits", "mqtt_bytes", skip_nan(F.abs("res")).alias("abs_res")
        ),
        "unique-events",
    )
    gaps = aoi.pooled_gaps(rows.select(*partition_keys(rows, stream), "ts_ns"), stream, max_rows=max_rows)
    gaps = staged(gaps.select(*group, "gap_ns"), "gaps")
    totals = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_events"),
        ((F.max("ts_ns") - F.min("ts_ns")) / F.lit(1e9)).alias("_span"),
        F.sum("mqtt_bytes").alias("_bytes"),
        F.avg("abs_res").alias("mae_event_mean"),
        F.avg("kbits").alias("kbits_mean"),
    )
    residual_p95 = exact_percentile(rows.select(*group, "abs_res"), group, "abs_res", 0.95, "mae_event_p95")
    duration = F.when(F.col("n_events") >= 2, F.col("_span")).otherwise(F.lit(NAN))
    nan = F.lit(NAN)
    return (
        totals.join(aoi.aoi_mean_and_p95(gaps, group), list(group), "left")
        .join(residual_p95, list(group), "left")
        .select(
            *group,
            "n_events",
            duration.alias("duration_s"),
            F.when(F.col("n_events") >= 2, bytes_per_second(F.col("_bytes"), F.col("_span")))
            .otherwise(nan)
            .alias("rate_Bps"),
            F.coalesce("aoi_mean_ms", nan).alias("aoi_mean_ms"),
            F.coalesce("aoi_p95_ms", nan).alias("aoi_p95_ms"),
            F.coalesce("mae_event_mean", nan).alias("mae_event_mean"),
            F.coalesce("mae_event_p95", nan).alias("mae_event_p95"),
            "kbits_mean",
        )
    )


def policy_rank(policy: Column) -> Column:
    """Position of a policy in reports; names outside the enum come last."""
    rank = F.lit(len(POLICIES))
    for i, name in enumerate(POLICIES):
        rank = F.when(policy == name, F.lit(i)).otherwise(rank)
    return rank


def summary_order() -> list[Column]:
    return [F.col("profile"), policy_rank(F.col("policy")), F.col("policy"), F.col("sensor")]


def log_order() -> list[Column]:
    """Device, sensor, time; the sequence number settles equal times."""
    return [F.col("device_id"), F.col("sensor"), F.col("ts_ns"), F.col("seq")]


def top_rows(summary: DataFrame, n: int) -> DataFrame:
    return summary.orderBy(*summary_order()).limit(n)


def scenario_count(events: DataFrame, group: Sequence[str] = SCENARIO) -> DataFrame:
    return events.select(*group).distinct().agg(F.count(F.lit(1)).alias("scenarios"))
