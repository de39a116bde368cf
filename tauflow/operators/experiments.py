"""Comparing policies over scenarios."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tauflow.functions.measures import percent_improvement
from tauflow.functions.quantize import quantize, sensor_range
from tauflow.operators.delta import send_on_delta
from tauflow.operators.sequence import MAX_ROWS
from tauflow.operators.summary import summarize
from tauflow.operators.trigger import Trigger
from tauflow.schemas import POLICIES, PROFILES
from tauflow.session import staged

# The goals of the comparison, in percent against periodic sending, and runs per cell.
RATE_GOAL, AOI_GOAL, MAE_GOAL = 60.0, 30.0, -10.0
RUNS_PER_CELL = 3
BASELINE = "periodic"


def scenario_grid(
    spark: SparkSession, profiles: Sequence[str] = PROFILES, modes: Sequence[str] = POLICIES
) -> DataFrame:
    """All pairs of profile and mode, named ``<profile>__<mode>``."""
    # A constant handful of rows, exploded from two literals.
    one = spark.range(1).select(F.explode(F.array(*map(F.lit, profiles))).alias("profile"))
    grid = one.select("profile", F.explode(F.array(*map(F.lit, modes))).alias("policy"))
    return grid.withColumn("name", F.concat_ws("__", "profile", "policy"))


def scenario_coverage(events: DataFrame, run: str, wanted: int = RUNS_PER_CELL) -> DataFrame:
    """Runs seen per cell of the grid, and how many are still missing."""
    seen = events.groupBy("profile", "policy").agg(F.countDistinct(run).alias("n_runs"), F.count(F.lit(1)).alias("n_events"))
    n_runs = F.coalesce("n_runs", F.lit(0))
    return scenario_grid(events.sparkSession).join(seen, ["profile", "policy"], "left").select(
        "name", "profile", "policy", n_runs.alias("n_runs"), F.coalesce("n_events", F.lit(0)).alias("n_events"),
        F.greatest(wanted - n_runs, F.lit(0)).alias("missing_runs"),
    )


def improvement_vs_baseline(summary: DataFrame, keys: Sequence[str] = ("profile", "sensor")) -> DataFrame:
    """Rate, age and error of each policy against periodic sending of the same profile and sensor.

    Works on summary rows, so the baseline side has one row per profile and sensor.
    """
    measures = {"rate": "rate_Bps", "aoi": "aoi_mean_ms", "mae": "mae_event_mean"}
    baseline = summary.where(F.col("policy") == BASELINE).select(
        *keys, *[F.col(c).alias(f"_{m}") for m, c in measures.items()]
    )
    compared = summary.where(F.col("policy") != BASELINE).join(baseline, list(keys))
    gains = {m: percent_improvement(F.col(f"_{m}"), F.col(c)) for m, c in measures.items()}
    goals = {"rate": RATE_GOAL, "aoi": AOI_GOAL, "mae": MAE_GOAL}
    # NaN sorts above every number, and must not pass a goal.
    met = [(~F.isnan(gains[m])) & (gains[m] >= goal) for m, goal in goals.items()]
    return compared.select(
        *keys,
        "policy",
        *[g.alias(f"{m}_gain_pct") for m, g in gains.items()],
        *[ok.alias(f"{m}_goal_met") for m, ok in zip(goals, met)],
    )


def pareto_front(points: DataFrame, keys: Sequence[str], cost: str = "rate_Bps", age: str = "aoi_mean_ms") -> DataFrame:
    """Points of each group that no other point beats on both measures; equal points stay together.

    A point survives if its age is below that of all cheaper points and the least among equally cheap ones. The
    group may be any set of points: the best age per cost is put in order in ranges of costs, each in a task of its own, and what the cheaper
    ranges have reached is carried over from one row per range.
    """
    usable = points.where(~F.isnan(cost) & ~F.isnan(age))
    # Only the best age per cost can survive, which leaves distinct costs to put in order.
    best = usable.groupBy(*keys, cost).agg(F.min(age).alias("_best"))
    # Written, so that both readings see the same ranges.
    ranged = staged(best.repartitionByRange(*keys, cost).withColumn("_range", F.spark_partition_id()), "cost-ranges")
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    reached = ranged.groupBy(*keys, "_range").agg(F.min("_best").alias("_least"))
    reached = reached.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_range").alias("_of"), F.min("_least").over(earlier).alias("_reached"))
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys] + [F.col("_range") == F.col("_of")]
    cheaper = Window.partitionBy(*keys, "_range").orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    bound = F.least(F.min("_best").over(cheaper), F.col("_reached"))
    front = ranged.join(reached, reduce(Column.__and__, same)).withColumn("_bound", bound).where(
        F.col("_bound").isNull() | (F.col("_best") < F.col("_bound"))
    )
    front = front.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col(cost).alias("_cost"), "_best")
    on_front = [*same[:-1], F.col(cost) == F.col("_cost"), F.col(age) == F.col("_best")]
    return usable.join(front, reduce(Column.__and__, on_front), "left_semi").select(*points.columns)


def policy_sweep(
    samples: DataFrame, settings: Sequence[Trigger], valid: str | None = None, max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Replay recorded readings under every setting and summarize what each would have sent.

    One pass over the readings serves all settings; only sent events are multiplied. Streams are cut once: an event
    keeps the slice of its reading.
    """
    labels = F.array(*[F.lit(t.name) for t in settings])
    sent = send_on_delta(samples, settings, valid=valid, max_rows=max_rows, keep_slices=True)
    named = sent.withColumn("setting_name", F.get(labels, F.col("setting")))
    group = ("setting_name", "profile", "policy", "sensor")
    return summarize(named, scope=("setting_name", "profile", "policy"), group=group, max_rows=max_rows)


def quantization_report(samples: DataFrame, depths: Mapping[str, Sequence[int]], value: str = "x") -> DataFrame:
    """Per sensor and bit depth: share of saturated readings, mean and largest error.

    The few depths of a sensor are exploded inside the map task, ahead of the partial aggregation.
    """
    per_row = F.array().cast("array<int>")
    for sensor, ks in depths.items():
        per_row = F.when(F.col("sensor") == sensor, F.array(*[F.lit(k) for k in ks])).otherwise(per_row)
    vmin, vmax = sensor_range(F.col("sensor"))
    x = F.col(value).cast("double")
    rows = samples.select("sensor", x.alias("_x"), F.explode(per_row).alias("kbits"))
    coded = rows.withColumn("_q", quantize(F.col("_x"), F.col("kbits"), vmin, vmax)).where(F.col("_q.code").isNotNull())
    error = F.abs(F.col("_x") - F.col("_q.q"))
    return coded.groupBy("sensor", "kbits").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("_q.saturated").cast("double")).alias("saturated_share"),
        F.avg(error).alias("mean_abs_error"),
        F.max(error).alias("max_abs_error"),
    )
