"""Exact order statistics of groups of any size.

A sort per group would put a whole group into one task, and the built-in exact percentile keeps every
distinct value of a group in one hash map. Here rows are first folded into narrow value bins (count, sum, least and
greatest value; partial aggregation, so only bins are shuffled, never values), a running sum over the bins finds the
one bin that holds the answer, and only that bin is looked at again: it is divided anew as long as it holds more
than ``KEPT_ROWS`` rows that are not all equal, and the rows left at the end are put in order. Nothing is approximated:
a bin is a set of neighbouring values, and bin borders never decide a result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tauflow.session import staged

# Bins per doubling of the value, so a bin spans a relative width of 1/2048; all doubles together
# have fewer than 2 * 2098 * 2048 bins.
BINS_PER_DOUBLING = 2_048
_ZERO_BIN = -(1 << 26)
# A found bin with more rows than this is divided into so many parts; in so many rounds doubles can be told apart to the last bit.
KEPT_ROWS, PARTS, MOST_ROUNDS = 200_000, 1 << 14, 5
EXACT = "decimal(38,0)"


def value_bin(v: Column) -> Column:
    """Bin number that never decreases as ``v`` grows."""
    v = v.cast("double")
    scale = F.floor(F.log2(F.abs(v)) * BINS_PER_DOUBLING)
    return F.when(v > 0, scale).when(v < 0, 2 * _ZERO_BIN - scale).otherwise(F.lit(_ZERO_BIN)).cast("bigint")


def _values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, _v): the values; null and NaN are passed over, the two zeros are one value."""
    v = F.col(value)
    df = df.where(v.isNotNull())
    if dict(df.dtypes)[value] in ("double", "float"):
        df, v = df.where(~F.isnan(v)), v.cast("double") + F.lit(0.0)
    return df.select(*keys, v.alias("_v"))


def _running(keys: Sequence[str], by: str):
    return Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)


def _part_of() -> Column:
    """Part of the found bin that a value lies in: never falls as the value grows."""
    v, low, high = (F.col(c).cast("double") for c in ("_v", "_low", "_high"))
    width = (high / PARTS) - (low / PARTS)  # never beyond the largest double
    return F.coalesce(F.least(F.floor((v - low) / F.when(width > 0, width)), F.lit(2 * PARTS)), F.lit(0)).cast("bigint")


def _inside(values: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of the found bin that still have to be told apart."""
    open_ = found.where(F.col("_low") < F.col("_high"))
    return values.join(open_, list(keys)).where(F.col("_v").between(F.col("_low"), F.col("_high")))


def _narrowed(values: DataFrame, keys: Sequence[str], found: DataFrame, again: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Divide found bins until each holds few rows or one value. ``again`` finds the part of a bin that holds the answer.

    Every round divides a bin by up to ``PARTS``, so doubles need four rounds at most; usually none.
    """
    found = staged(found, "found-bins")
    for _ in range(MOST_ROUNDS):
        full = (F.col("_n") > KEPT_ROWS) & (F.col("_low") < F.col("_high"))
        if found.where(full).limit(1).isEmpty():
            break
        found = staged(found.where(~full).unionByName(again(found.where(full))), "found-bins")
    return found


def exact_percentile(df: DataFrame, keys: Sequence[str], value: str, p: float, name: str) -> DataFrame:
    """Percentile with linear interpolation between the two neighbouring ranks."""
    keys = list(keys)
    values = _values(df, keys, value)
    group, in_order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_bin")
    counted = [F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")]
    columns = [*keys, "_low", "_high", "_n", "_below", "_next", "_position", "_k"]

    def holding(bins: DataFrame) -> DataFrame:
        """The bin with rank k (from 0); rank k + 1 is in it, too, or is the least value after it."""
        bins = bins.withColumn("_below", F.col("_start") + F.sum("_n").over(_running(keys, "_bin")) - F.col("_n"))
        bins = bins.withColumn("_next", F.coalesce(F.lead("_low").over(in_order), F.col("_after")))
        return bins.where((F.col("_below") <= F.col("_k")) & (F.col("_below") + F.col("_n") > F.col("_k"))).select(*columns)

    def again(full: DataFrame) -> DataFrame:
        rows = _inside(values, full, keys).withColumn("_bin", _part_of())
        carried = [F.any_value(c).alias(n) for c, n in (("_below", "_start"), ("_next", "_after"), ("_position", "_position"), ("_k", "_k"))]
        return holding(rows.groupBy(*keys, "_bin").agg(*counted, *carried))

    bins = values.groupBy(*keys, value_bin(F.col("_v")).alias("_bin")).agg(*counted)
    position = F.lit(p) * (F.sum("_n").over(group) - 1)
    bins = bins.withColumn("_position", position).withColumn("_k", F.floor("_position"))
    bins = bins.withColumn("_start", F.lit(0)).withColumn("_after", F.lit(None).cast(values.schema["_v"].dataType))
    found = _narrowed(values, keys, holding(bins), again)

    share = F.col("_position") - F.col("_k")
    one = found.where(F.col("_low") == F.col("_high"))
    last = F.col("_below") + F.col("_n") == F.col("_k") + 1
    one = one.select(*keys, F.col("_low").alias("_a"), F.when(last, F.col("_next")).otherwise(F.col("_low")).alias("_b"), share.alias("_share"))
    rank = F.col("_below") + F.row_number().over(Window.partitionBy(*keys).orderBy("_v")) - 1
    few = _inside(values, found, keys).withColumn("_rank", rank).groupBy(*keys).agg(
        F.min(F.when(F.col("_rank") == F.col("_k"), F.col("_v"))).alias("_a"),
        F.coalesce(F.min(F.when(F.col("_rank") == F.col("_k") + 1, F.col("_v"))), F.any_value("_next")).alias("_b"),
        F.any_value(share).alias("_share"))
    a = F.col("_a")
    return one.unionByName(few).select(*keys, (a + (F.coalesce("_b", a) - a) * F.col("_share")).alias(name))


def _gap_sums() -> list[Column]:
    """Count, exact sum, least and greatest length of the gaps of a bin."""
    return [
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("_v").cast("decimal(20,0)")).cast(EXACT).alias("_s"),
        F.min("_v").alias("_low"), F.max("_v").alias("_high"),
    ]


def _gap_bins(gaps: DataFrame, keys: Sequence[str], more: Sequence[Column] = ()) -> DataFrame:
    """Per bin of gap lengths: count, sum, smallest, largest, and both totals up to and below the bin."""
    group = Window.partitionBy(*keys)
    bins = gaps.groupBy(*keys, value_bin(F.col("_v")).alias("_bin")).agg(*_gap_sums(), *more)
    return (
        _with_totals_below(bins.withColumns({"_n_start": F.lit(0), "_s_start": F.lit(0).cast(EXACT)}), keys)
        .withColumn("_n_all", F.sum("_n").over(group))
        .withColumn("_s_all", F.sum("_s").over(group).cast(EXACT))
        .where(F.col("_s_all") > 0)
    )


def _with_totals_below(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        bins.withColumn("_n_upto", F.col("_n_start") + F.sum("_n").over(_running(keys, "_bin")))
        .withColumn("_s_upto", (F.col("_s_start") + F.sum("_s").over(_running(keys, "_bin"))).cast(EXACT))
        .withColumn("_n_below", F.col("_n_upto") - F.col("_n"))
        .withColumn("_s_below", (F.col("_s_upto") - F.col("_s")).cast(EXACT))
    )


def _square_sums() -> list[Column]:
    """Sum of squared gaps of a bin: exact, and as a double for when 38 digits do not hold it."""
    v = F.col("_v").cast("decimal(19,0)")
    wide = F.col("_v").cast("double") * F.col("_v").cast("double")
    return [F.try_sum((v * v).cast(EXACT)).cast(EXACT).alias("_q"), F.sum(wide).alias("_q_wide")]


def age_percentile(
    gaps: DataFrame, keys: Sequence[str], gap: str, p: float, name: str, mean: str | None = None
) -> DataFrame:
    """The age a that is not exceeded for a share ``p`` of the time: sum(min(a, gap)) = p * sum(gap).

    The left side grows with a, and at a gap length v it equals the sum of all shorter gaps plus v for
    each gap that is not shorter; the answer lies just below the first v where it reaches the target.
    With ``mean`` the mean age, sum(gap^2) / (2 * sum(gap)), comes along from the same bins.
    """
    keys = list(keys)
    values = _values(gaps, keys, gap)
    group = Window.partitionBy(*keys)
    target = F.lit(p) * F.col("_s_all").cast("double")
    totals = ["_n_all", "_s_all", *(["_mean"] if mean else [])]
    columns = [*keys, "_low", "_high", "_n", "_n_below", "_s_below", *totals]

    def holding(bins: DataFrame) -> DataFrame:
        """The first bin whose greatest gap reaches the target (the last one, should rounding keep it just below)."""
        reached = F.col("_s_upto").cast("double") + F.col("_high").cast("double") * (F.col("_n_all") - F.col("_n_upto")) >= target
        first = F.coalesce(F.min(F.when(reached, F.col("_bin"))).over(group), F.max("_bin").over(group))
        return bins.withColumn("_first_bin", first).where(F.col("_bin") == F.col("_first_bin")).select(*columns)

    def again(full: DataFrame) -> DataFrame:
        rows = _inside(values, full, keys).withColumn("_bin", _part_of())
        carried = [F.any_value(c).alias(n) for c, n in (("_n_below", "_n_start"), ("_s_below", "_s_start"), *zip(totals, totals))]
        return holding(_with_totals_below(rows.groupBy(*keys, "_bin").agg(*_gap_sums(), *carried), keys))

    bins = _gap_bins(values, keys, _square_sums() if mean else [])
    if mean:
        any_lost = F.count_if(F.col("_q").isNull()).over(group) > 0
        square_sum = F.when(any_lost, None).otherwise(F.try_sum("_q").over(group).cast("double"))
        square_sum = F.coalesce(square_sum, F.sum("_q_wide").over(group))
        bins = bins.withColumn("_mean", square_sum / (2.0 * F.col("_s_all").cast("double")))
    found = _narrowed(values, keys, holding(bins), again)

    one = found.where(F.col("_low") == F.col("_high")).withColumns({"_v": F.col("_low"), "_n_less": F.lit(0), "_s_less": F.lit(0).cast(EXACT)})
    less = Window.partitionBy(*keys).orderBy("_v").rangeBetween(Window.unboundedPreceding, -1)
    few = _inside(values, found, keys).withColumns({
        "_n_less": F.count(F.lit(1)).over(less), "_s_less": F.coalesce(F.sum(F.col("_v").cast("decimal(20,0)")).over(less), F.lit(0)).cast(EXACT)})
    left = F.col("_n_all") - F.col("_n_below") - F.col("_n_less")
    shorter = (F.col("_s_below") + F.col("_s_less")).cast("double")
    reached = shorter + F.col("_v").cast("double") * left >= target
    age = (target - shorter) / left
    extra = [F.any_value("_mean").alias(mean)] if mean else []
    names = [*columns, "_v", "_n_less", "_s_less"]
    return one.select(*names).unionByName(few.select(*names)).groupBy(*keys).agg(
        F.coalesce(F.min_by(age, F.when(reached, F.col("_v"))), F.max_by(age, "_v")).alias(name), *extra)


def age_percentile_loop(gaps: DataFrame, keys: Sequence[str], gap: str, p: float, name: str) -> DataFrame:
    """The value older reports show as the percentile; it does not solve the equation above.

    With L(i) the sum of the i longest gaps, it is a(i) = (p * total - L(i)) / i for the first i where
    i is the number of gaps or a(i) is at most the (i+1)-th shortest gap, and at least 0. As i grows, a(i)
    falls (until it is negative) and the (i+1)-th shortest gap rises, so the first i can be bracketed from the bins.
    """
    gap_values = _values(gaps, keys, gap).withColumn("_bin", value_bin(F.col("_v")))
    bins = staged(_gap_bins(gap_values, keys).withColumnsRenamed({"_low": "_smallest", "_high": "_largest"}), "gap-bins")
    target = F.lit(p) * F.col("_s_all").cast("double")
    n_all, i = F.col("_n_all"), F.col("_i")

    # Where a bin's gaps have all been counted from the long end, L(i) is known; the (i+1)-th shortest gap
    # is known to lie within the bin that covers this rank.
    no_sum = F.lit(None).cast("double")
    as_long = bins.select(
        *keys, (n_all - F.col("_n_below")).alias("_i"), F.lit(1).alias("_kind"), n_all, F.col("_s_all"),
        (F.col("_s_all") - F.col("_s_below")).cast("double").alias("_longest"),
        F.lit(None).cast("bigint").alias("_smallest"), F.lit(None).cast("bigint").alias("_largest"),
    )
    as_short = bins.select(
        *keys, F.col("_n_below").alias("_i"), F.lit(0).alias("_kind"), n_all, F.col("_s_all"),
        no_sum.alias("_longest"), "_smallest", "_largest",
    )
    in_rank_order = Window.partitionBy(*keys).orderBy("_i", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    a = (target - F.col("_longest")) / i
    tested = (
        as_long.unionByName(as_short)
        .withColumn("_smallest", F.last("_smallest", ignorenulls=True).over(in_rank_order))
        .withColumn("_largest", F.last("_largest", ignorenulls=True).over(in_rank_order))
        .where(F.col("_kind") == 1)
        .withColumn("_a", a)
    )
    bracket = tested.groupBy(*keys).agg(
        F.min(F.when((i == n_all) | (F.col("_a") <= F.col("_smallest")), i)).alias("_i_to"),
        F.coalesce(F.max(F.when((i < n_all) & (F.col("_a") > F.col("_largest")), i)), F.lit(0)).alias("_i_from"),
    )
    # Gaps that are among the i longest, or the (i+1)-th shortest, for some i in (i_from, i_to].
    from_long = (n_all - F.col("_n_upto") < F.col("_i_to")) & (n_all - F.col("_n_below") > F.col("_i_from"))
    from_short = (F.col("_n_below") <= F.col("_i_to")) & (F.col("_n_upto") > F.col("_i_from"))
    kept = (
        bins.join(bracket, list(keys))
        .withColumn("_from_long", from_long)
        .withColumn("_from_short", from_short)
        .where(from_long | from_short)
        .select(*keys, "_bin", "_n_below", "_s_below", "_n_all", "_s_all", "_i_from", "_i_to", "_from_long", "_from_short")
    )
    in_bin = _running([*keys, "_bin"], "_v")
    product = (F.col("_v").cast("decimal(20,0)") * F.col("_c").cast("decimal(18,0)")).cast(EXACT)
    kept = staged(kept, "kept-bins")
    # Only gaps of the bins that are left are counted by length.
    counts = gap_values.join(kept.select(*keys, "_bin"), [*keys, "_bin"], "left_semi")
    counts = counts.groupBy(*keys, "_bin", "_v").agg(F.count(F.lit(1)).alias("_c"))
    values = (
        counts.join(kept, [*keys, "_bin"])
        .withColumn("_v_n_upto", F.col("_n_below") + F.sum("_c").over(in_bin))
        .withColumn("_v_s_upto", (F.col("_s_below") + F.sum(product).over(in_bin)).cast(EXACT))
    )
    # Stretches of i over which the next long gap (v_long) and the next short gap (v_short) stay the same.
    common = [*keys, "_n_all", "_s_all", "_i_from", "_i_to"]
    nothing = F.lit(None).cast("bigint")
    long_runs = values.where("_from_long").select(
        *common, (n_all - F.col("_v_n_upto") + 1).alias("_i"), F.col("_v").cast("double").alias("_v_long"),
        (n_all - F.col("_v_n_upto")).alias("_before_n"),
        (F.col("_s_all") - F.col("_v_s_upto")).cast("double").alias("_before_s"), no_sum.alias("_v_short"),
    )
    short_runs = values.where("_from_short").select(
        *common, (F.col("_v_n_upto") - F.col("_c")).alias("_i"), no_sum.alias("_v_long"), nothing.alias("_before_n"),
        no_sum.alias("_before_s"), F.col("_v").cast("double").alias("_v_short"),
    )
    by_i = Window.partitionBy(*keys).orderBy("_i")
    so_far = by_i.rangeBetween(Window.unboundedPreceding, 0)
    # Within one kind starts are distinct, so rows of equal i never compete for a column.
    filled = [
        F.last(c, ignorenulls=True).over(so_far).alias(c) for c in ("_v_long", "_before_n", "_before_s", "_v_short")
    ]
    stretches = long_runs.unionByName(short_runs).select(*common, "_i", *filled)
    stretches = (
        stretches.dropDuplicates([*keys, "_i"])
        .withColumn("_start", F.greatest(i, F.col("_i_from") + 1, F.lit(1)))
        .withColumn("_end", F.least(F.coalesce(F.lead("_i").over(by_i) - 1, n_all), F.col("_i_to")))
        .where((F.col("_start") <= F.col("_end")) & F.col("_v_long").isNotNull())
    )
    both = F.col("_v_long") + F.coalesce("_v_short", F.lit(0.0))
    crossing = F.ceil((target - F.col("_before_s") + F.col("_before_n") * F.col("_v_long")) / both)
    found = F.when((both > 0) & F.col("_v_short").isNotNull(), F.greatest(crossing, F.col("_start")))
    # The last i needs no comparison.
    found = F.when(found <= F.col("_end"), found).when(F.col("_end") == n_all, n_all)
    result = stretches.withColumn("_i", found).where(i.isNotNull()).withColumn(
        "_a", (target - F.col("_before_s") - (i - F.col("_before_n")) * F.col("_v_long")) / i
    )
    return result.groupBy(*keys).agg(F.greatest(F.min_by("_a", "_i"), F.lit(0.0)).alias(name))
