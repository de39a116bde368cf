"""Row order inside a stream, without ever needing one task per stream.

A window over (device, sensor) puts a whole stream into one task. One stream may hold a third of
all rows, so long streams are first cut into slices of about equally many rows (``cut_long_streams``); each
slice is windowed on its own, and the little that has to cross a slice border (last row, last known value, row
count) is carried over from a per-slice summary. Streams below the limit are never cut and pay only
for a row count. The operators here use the slices if the input has been cut, and leave the
``_slice`` column in place for the next one.

Where to cut comes from a histogram of times that is refined where it has to be: rows are counted in equal
stretches of a stream's time, a stretch with more than ``max_rows`` rows is divided again, and so on; then the
counts are summed up in order of time and a new slice begins whenever ``max_rows`` more rows have gone by. So bursts
and single clocks that are far off leave the slices as even as a steady rate does: a slice has at most 2 * ``max_rows``
rows, or those of one single point of time, which are never parted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tauflow.session import staged

SLICE = "_slice"
MAX_ROWS = 5_000_000
_LEAST_PARTS, _EARLIEST = 64, -(1 << 61)


def cut_long_streams(
    df: DataFrame, keys: Sequence[str], ts: str = "ts_ns", max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Add column ``_slice``: null for streams of at most ``max_rows`` rows, else the number of the slice, from 0 in order of time.

    One job counts the streams' rows; where none is long (or ``max_rows`` is None) the input comes back as it is, without
    the column. Otherwise each round of the histogram is a pass over the key and time columns of what is still too
    full: one round for steady streams, at most eleven for any 64-bit times. Null is a key like any other; rows without a
    time count as earliest. A round's table has at most about 64 * (all rows / max_rows) rows.
    """
    if max_rows is None:
        return df
    t = F.coalesce(F.col(ts).cast("bigint"), F.lit(_EARLIEST))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(t).alias("_start"), F.max(t).alias("_to"))
    full = sizes.where(F.col("_n") > max_rows)
    if full.limit(1).isEmpty():
        return df
    full = full.withColumn("_span", F.col("_to") - F.col("_start") + 1).withColumn("_on", F.lit(None).cast("bigint"))
    nowhere = F.lit(None).cast("bigint").alias("_at")
    rows, rounds, leaves = df.select(*keys, t.alias("_t"), nowhere), [], []
    while True:
        parts = F.greatest(F.lit(_LEAST_PARTS), F.ceil(4 * F.col("_n") / max_rows))
        width = F.ceil(F.col("_span") / parts).cast("bigint")
        rounds.append(staged(full.select(*keys, "_on", "_start", width.alias("_width")), "full-stretches"))
        rows = _placed(rows, rounds[-1], keys)
        inside = rows.where(F.col("_width").isNotNull()).groupBy(*keys, "_at", F.col("_width").alias("_span"))
        counted = staged(inside.agg(F.count(F.lit(1)).alias("_n")), "time-histogram")
        too_full = (F.col("_n") > max_rows) & (F.col("_span") > 1)
        leaves.append(counted.where(~too_full))
        full = counted.where(too_full)
        if full.limit(1).isEmpty():
            break
        rows = rows.drop("_width")
        full = full.select(*keys, F.col("_at").alias("_on"), F.col("_at").alias("_start"), "_span", "_n")
    before = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    number = F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / max_rows)
    slices = reduce(DataFrame.unionByName, leaves).select(*keys, F.col("_at").alias("_on"), number.alias(SLICE))
    out = df.withColumns({"_t": t, "_at": nowhere})
    for stretches in rounds:
        out = _placed(out, stretches, keys).drop("_width")
    return _matched(out, staged(slices, "slices"), keys).select(*df.columns, SLICE)


def _placed(rows: DataFrame, stretches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a divided stretch get the start of the part they lie in as ``_at`` and its ``_width``; others keep ``_at``, with null."""
    part = F.col("_t") - F.pmod(F.col("_t") - F.col("_start"), F.col("_width"))
    found = _matched(rows, stretches, keys).withColumn("_at", F.coalesce(part, F.col("_at")))
    return found.select(*rows.columns, "_width")


def _matched(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join by keys, null among them, and ``_at``. Without a hint: the planner knows the written table's size."""
    there = table.withColumnsRenamed({k: f"_key{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)] + [F.col("_at").eqNullSafe(F.col("_on"))]
    return rows.join(there, reduce(Column.__and__, same), "left")


def partition_keys(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """What a window or a per-stream step has to be partitioned by."""
    return [*keys, SLICE] if SLICE in df.columns else list(keys)


def _with_carried(
    out: DataFrame,
    df: DataFrame,
    keys: Sequence[str],
    summary: Column,
    carry: Callable[[WindowSpec], Column],
    newest_first: bool = False,
) -> DataFrame:
    """Join to the rows of each slice of a long stream what the slices before it amount to.

    The rows are already partitioned by (keys, slice) for their window, so the join moves only the
    summary, one row per slice.
    """
    by = F.col(SLICE).desc() if newest_first else F.col(SLICE)
    carried = (
        df.where(F.col(SLICE).isNotNull())
        .groupBy(*keys, SLICE)
        .agg(summary.alias("_own"))
        .withColumn("_carried", carry(Window.partitionBy(*keys).orderBy(by)))
        .select(*keys, SLICE, "_carried")
    )
    return out.join(carried, [*keys, SLICE], "left").select(*out.columns, "_carried")


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str]
) -> DataFrame:
    """Add the value each column of ``columns`` had one row earlier, under its new name."""
    w = Window.partitionBy(*partition_keys(df, keys)).orderBy(*order)
    if SLICE not in df.columns:
        return df.select("*", *[F.lag(c).over(w).alias(new) for c, new in columns.items()])
    row = F.struct(*[F.col(c).alias(new) for c, new in columns.items()])
    out = df.withColumn("_before", F.lag(row).over(w))
    out = _with_carried(out, df, keys, F.max_by(row, F.struct(*order)), lambda w: F.lag("_own").over(w))
    before = F.coalesce("_before", "_carried")
    return out.select(
        *df.columns, *[before.getField(new).alias(new) for new in columns.values()]
    )


def with_last_known(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str
) -> DataFrame:
    """Add the latest non-null ``value`` at or before each row."""
    df = df.withColumn("_value", value)
    w = Window.partitionBy(*partition_keys(df, keys)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn(name, F.last("_value", ignorenulls=True).over(w))
    if SLICE in df.columns:
        newest = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order)))
        out = _with_carried(
            out, df, keys, newest,
            lambda w: F.last("_own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        )
        out = out.withColumn(name, F.coalesce(name, "_carried")).drop("_carried")
    return out.drop("_value")


def with_row_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, start: int = 0, newest_first: bool = False
) -> DataFrame:
    """Number the rows of each stream from ``start``, oldest or newest first."""
    by = [F.col(c).desc() if newest_first else F.col(c) for c in order]
    w = Window.partitionBy(*partition_keys(df, keys)).orderBy(*by)
    out = df.withColumn(name, F.row_number().over(w).cast("bigint") + (start - 1))
    if SLICE in df.columns:
        out = _with_carried(
            out, df, keys, F.count(F.lit(1)),
            lambda w: F.sum("_own").over(w.rowsBetween(Window.unboundedPreceding, -1)),
            newest_first,
        )
        out = out.withColumn(name, F.col(name) + F.coalesce("_carried", F.lit(0))).drop("_carried")
    return out


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, valid: str, name: str
) -> DataFrame:
    """Show the last stored reading where a row is invalid.

    The first row of a stream is stored whatever its flag says, so a stream that begins with failed
    readings shows the first of them (possibly NaN) until a valid one comes.
    """
    numbered = with_row_index(df, keys, order, "_row")
    stored = F.when(F.col(valid) | (F.col("_row") == 0), F.col(value))
    return with_last_known(numbered, keys, order, stored, name).drop("_row")


def persistence_forecast(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, a: float = 1.0, name: str = "forecast"
) -> DataFrame:
    """Forecast ``a`` times the previous reading; null in the first row of a stream."""
    return with_previous(df, keys, order, {value: "_x"}).withColumn(name, F.lit(float(a)) * F.col("_x")).drop("_x")


def ar1_rls_fit(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, forgetting: float = 0.99
) -> DataFrame:
    """Coefficient of x[n] = a * x[n-1] per stream, older rows weighted down by ``forgetting`` per row.

    The recursive update with exponential forgetting has this weighted regression as its closed form,
    so it needs no sequential state: rows are numbered from the newest one and summed.
    """
    pairs = with_previous(df, keys, order, {value: "_x1"})
    aged = with_row_index(pairs, keys, order, "_age", newest_first=True).where(F.col("_x1").isNotNull())
    weight = F.pow(F.lit(forgetting), F.col("_age"))
    up, down = F.sum(weight * F.col(value) * F.col("_x1")), F.sum(weight * F.col("_x1") * F.col("_x1"))
    return aged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.when(down > 0, up / down).otherwise(F.lit(1.0)).alias("a")
    )
