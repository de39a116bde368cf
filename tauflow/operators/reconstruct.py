"""The receiver's view: the last value sent, at every original reading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tauflow.functions.measures import skip_nan
from tauflow.operators.sequence import MAX_ROWS, SLICE, cut_long_streams, with_last_known
from tauflow.schemas import STREAM


def reconstruct_hold(
    readings: DataFrame,
    sent: DataFrame,
    keys: Sequence[str] = STREAM,
    value: str = "x",
    sent_value: str = "val",
    name: str = "restored",
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Add to each reading the last value sent at or before its time; null before the first one.

    Both tables go through one shuffle as one table and the latest sent value is carried along, so there
    is no join whose output could grow. At equal times the sent value comes first.
    """
    keys = list(keys)
    columns = readings.columns
    original = readings.withColumn("_sent", F.lit(None).cast("double")).withColumn("_kind", F.lit(1))
    messages = sent.select(*keys, "ts_ns", "seq", F.col(sent_value).alias("_sent"), F.lit(0).alias("_kind"))
    both = original.unionByName(messages, allowMissingColumns=True)
    both = cut_long_streams(both, keys, max_rows=max_rows)
    filled = with_last_known(both, keys, ("ts_ns", "_kind", "seq"), F.col("_sent"), name)
    return filled.where(F.col("_kind") == 1).select(*columns, name)


def full_series_mae(
    readings: DataFrame, sent: DataFrame, group: Sequence[str], keys: Sequence[str] = STREAM, value: str = "x",
    sent_value: str = "val", max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Mean distance of all original readings from the receiver's view."""
    held = reconstruct_hold(readings, sent, keys, value, sent_value, max_rows=max_rows)
    error = skip_nan(F.abs(F.col(value) - F.col("restored")))
    return held.groupBy(*group).agg(
        F.count(error).alias("n_readings"), F.avg(error).alias("mae_full"), F.max(error).alias("max_error")
    )
