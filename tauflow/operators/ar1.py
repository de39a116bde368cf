"""The AR(1) coefficient after every reading, by recursive least squares with forgetting.

The update keeps two decayed sums, up = sum(w * x[n] * x[n-1]) and down = sum(w * x[n-1]^2), where a row weighs ``forgetting`` times the
row after it; the coefficient is up / down. A stretch of rows turns the sums before it, S, into ``forgetting ** n * S + own``, and two
such steps are one again. So the slices of a long stream are summed up each on its own, their steps are put together from one row
per slice, and then all slices run at the same time from the sums they begin with. A task holds one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tauflow.operators.sequence import SLICE, partition_keys, with_previous


def ar1_rls_update(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, forgetting: float = 0.99, a: str = "a", forecast: str = "forecast"
) -> DataFrame:
    """Add the coefficient of x[n] = a * x[n-1] as known after each reading, and the forecast of the next one (a * x[n]).

    Until the sums hold anything (first row, or zeros only) the coefficient is 1. A null reading adds nothing, but the
    older rows weigh less after it; its forecast is null.
    """
    own = partition_keys(df, keys)
    x, x1 = F.col(value).cast("double"), F.col("_x1").cast("double")
    pairs = with_previous(df, keys, order, {value: "_x1"})
    pairs = pairs.withColumns({"_up": F.coalesce(x * x1, F.lit(0.0)), "_down": F.when(x.isNotNull(), x1 * x1).otherwise(F.lit(None))})
    pairs = pairs.withColumn("_down", F.coalesce("_down", F.lit(0.0))).drop("_x1")
    in_order = Window.partitionBy(*own).orderBy(*order)
    rows = pairs.withColumn("_first", F.row_number().over(in_order) == 1)
    if SLICE in df.columns:
        starts = _slice_starts(pairs, keys, order, forgetting)
        same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)] + [F.col(SLICE) == F.col("_of")]
        condition = same[0]
        for c in same[1:]:
            condition = condition & c
        rows = rows.join(starts, condition, "left").select(*rows.columns, "_up0", "_down0")
    else:
        rows = rows.withColumns({"_up0": F.lit(0.0), "_down0": F.lit(0.0)})
    rows = rows.fillna(0.0, ["_up0", "_down0"]).withColumn("_x", x)
    ordered = rows.repartition(*own).sortWithinPartitions(*own, *order)
    out = T.StructType([*df.schema, T.StructField(a, T.DoubleType()), T.StructField(forecast, T.DoubleType())])
    return ordered.mapInPandas(_updates(forgetting, list(df.columns), a, forecast), out)


def _slice_starts(pairs: DataFrame, keys: Sequence[str], order: Sequence[str], forgetting: float) -> DataFrame:
    """The decayed sums that each slice of a long stream begins with, from one row per slice."""
    newest_first = Window.partitionBy(*keys, SLICE).orderBy(*[F.col(c).desc() for c in order])
    aged = pairs.where(F.col(SLICE).isNotNull()).withColumn("_age", F.row_number().over(newest_first) - 1)
    weight = F.pow(F.lit(forgetting), F.col("_age"))
    steps = aged.groupBy(*keys, SLICE).agg(
        F.pow(F.lit(forgetting), F.count(F.lit(1))).alias("decay"), F.sum(weight * F.col("_up")).alias("up"), F.sum(weight * F.col("_down")).alias("down"))
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.collect_list(F.struct("decay", "up", "down")).over(before)
    nothing = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"))
    folded = F.aggregate(
        "_steps", nothing,
        lambda s, step: F.struct((step.decay * s.up + step.up).alias("up"), (step.decay * s.down + step.down).alias("down")))
    started = steps.withColumn("_steps", earlier).withColumn("_start", folded)
    return started.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col(SLICE).alias("_of"), F.col("_start.up").alias("_up0"), F.col("_start.down").alias("_down0"))


def _updates(forgetting: float, columns: list[str], a: str, forecast: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up = down = 0.0
        for batch in batches:
            coefficients = []
            for first, up0, down0, own_up, own_down in zip(*(batch[c].tolist() for c in ("_first", "_up0", "_down0", "_up", "_down"))):
                if first:
                    up, down = up0, down0
                up, down = forgetting * up + own_up, forgetting * down + own_down
                coefficients.append(up / down if down > 0 else 1.0)
            known = pd.Series(coefficients, index=batch.index, dtype="float64")
            yield batch[columns].assign(**{a: known, forecast: known * batch["_x"]})

    return run
