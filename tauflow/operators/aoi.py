"""Age of Information: how old the receiver's newest value is, from the gaps between events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tauflow.functions.measures import NAN
from tauflow.operators import ranks
from tauflow.operators.sequence import MAX_ROWS, SLICE, cut_long_streams, partition_keys, with_previous

NS_PER_MS = 1e6


def event_gaps(
    events: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = ("ts_ns", "seq"),
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Add ``gap_ns``, the time since the previous event of the stream; null in its first row."""
    if SLICE not in events.columns:
        events = cut_long_streams(events, keys, order[0], max_rows)
    return (
        with_previous(events, keys, order, {"ts_ns": "_previous"})
        .withColumn("gap_ns", F.col("ts_ns") - F.col("_previous"))
        .drop("_previous", SLICE)
    )


def pooled_gaps(
    events: DataFrame, keys: Sequence[str], ts: str = "ts_ns", max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """(keys, gap_ns): the gaps of each stream, where it does not matter which rows they lie between.

    Order among equal times then does not matter, either, and what crosses the border of two slices is the step from the
    latest time of one to the earliest of the next: a row per slice, and no join.
    """
    if SLICE not in events.columns:
        events = cut_long_streams(events, keys, ts, max_rows)
    by = list(reversed(partition_keys(events, keys)))
    rows = events.select(*by, ts).repartition(*by)
    gap = (F.col(ts) - F.lag(ts).over(Window.partitionBy(*by).orderBy(ts))).alias("gap_ns")
    gaps = rows.select(*keys, gap)
    if SLICE in events.columns:
        ends = rows.groupBy(*by).agg(F.min(ts).alias("_from"), F.max(ts).alias("_to"))
        before = F.lag("_to").over(Window.partitionBy(*reversed(keys)).orderBy(SLICE))
        gaps = gaps.unionByName(ends.select(*keys, (F.col("_from") - before).alias("gap_ns")))
    return gaps.where(F.col("gap_ns").isNotNull())


def arrival_gaps(
    arrivals: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = ("t_recv_ns", "seq"),
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Gaps in order of arrival: backward steps give no gap, but the clock still follows them."""
    gaps = event_gaps(arrivals, keys, order, max_rows)
    return gaps.withColumn("gap_ns", F.when(F.col("gap_ns") >= 0, F.col("gap_ns")))


def mean_age_ms(gap_sum, square_sum):
    return F.when(gap_sum > 0, square_sum.cast("double") / (2.0 * gap_sum.cast("double")) / NS_PER_MS).otherwise(
        F.lit(NAN)
    )


def gap_sum(gap: str = "gap_ns"):
    return F.sum(F.col(gap).cast("decimal(20,0)"))


def gap_square_sum(gap: str = "gap_ns"):
    """Exact sum of squared gaps; a double only where 38 digits do not hold it."""
    d = F.col(gap).cast("decimal(19,0)")
    wide = F.col(gap).cast("double")
    return F.coalesce(F.try_sum((d * d).cast(ranks.EXACT)).cast("double"), F.sum(wide * wide))


def aoi_mean(gaps: DataFrame, group: Sequence[str], name: str = "aoi_mean_ms") -> DataFrame:
    """Mean age per group: sum(gap^2) / (2 * sum(gap)); NaN without a positive gap."""
    return gaps.groupBy(*group).agg(mean_age_ms(gap_sum(), gap_square_sum()).alias(name))


def aoi_percentile(gaps: DataFrame, group: Sequence[str], p: float = 0.95, name: str = "aoi_p95_ms") -> DataFrame:
    """Age not exceeded for a share ``p`` of the time; groups without a positive gap have no row."""
    _check_share(p)
    return ranks.age_percentile(gaps, group, "gap_ns", p, name).withColumn(name, F.col(name) / NS_PER_MS)


def aoi_percentile_loop(
    gaps: DataFrame, group: Sequence[str], p: float = 0.95, name: str = "aoi_p95_loop_ms"
) -> DataFrame:
    """The percentile as older reports computed it, for comparison with them."""
    _check_share(p)
    return ranks.age_percentile_loop(gaps, group, "gap_ns", p, name).withColumn(name, F.col(name) / NS_PER_MS)


def aoi_mean_and_p95(gaps: DataFrame, group: Sequence[str]) -> DataFrame:
    """Both measures from one pass over the gaps; groups without a positive gap have no row."""
    both = ranks.age_percentile(gaps, group, "gap_ns", 0.95, "aoi_p95_ms", mean="aoi_mean_ms")
    return both.withColumns({c: F.col(c) / NS_PER_MS for c in ("aoi_mean_ms", "aoi_p95_ms")})


def online_var(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Count, mean, sample variance and deviation; NaN where too few values are there."""
    nan = F.lit(NAN)
    return df.groupBy(*group).agg(
        F.count(value).alias("n"),
        F.coalesce(F.avg(value), nan).alias("mean"),
        F.coalesce(F.var_samp(value), nan).alias("var"),
        F.coalesce(F.stddev_samp(value), nan).alias("std"),
    )


def _check_share(p: float) -> None:
    if not 0.0 < p < 1.0:
        raise ValueError("p must lie between 0 and 1")
