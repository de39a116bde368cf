"""Age percentiles and exact percentiles against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tauflow.operators import aoi, ranks


def definition(gaps, p):
    """Bisection on sum(min(a, gap)) = p * sum(gap)."""
    low, high = 0.0, float(max(gaps))
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(mid, g) for g in gaps) < p * sum(gaps) else (low, mid)
    return high


def older_loop(gaps, p):
    rising = sorted(gaps)
    for i in range(1, len(rising) + 1):
        a = (p * sum(rising) - sum(rising[-i:])) / i
        if i == len(rising) or a <= rising[i]:
            return max(a, 0.0)


def age(spark, groups, p, f):
    rows = [(k, int(g * 1e6)) for k, gaps in groups.items() for g in gaps]
    df = spark.createDataFrame(rows, "k string, gap_ns long")
    return {r[0]: r[1] for r in f(df, ["k"], p, "a").collect()}


def test_known_cases(spark):
    groups = {"one": [1000], "ten": [1000] * 10, "mixed": [100] * 90 + [5000] * 10}
    assert age(spark, groups, 0.95, aoi.aoi_percentile) == {"one": 950.0, "ten": 950.0, "mixed": 4705.0}
    loop = age(spark, groups, 0.95, aoi.aoi_percentile_loop)
    assert loop["one"] == 0.0 and loop["ten"] == pytest.approx(900.0) and loop["mixed"] == pytest.approx(95.83, abs=0.01)


@pytest.mark.parametrize("p, kept", [(0.05, None), (0.5, 2), (0.95, None), (0.95, 2), (0.999, 0)])
def test_random_gaps(spark, monkeypatch, p, kept):
    if kept is not None:  # bins are divided again
        monkeypatch.setattr(ranks, "KEPT_ROWS", kept)
        monkeypatch.setattr(ranks, "PARTS", 8)
        monkeypatch.setattr(ranks, "MOST_ROUNDS", 30)
    rng = np.random.default_rng(7)
    groups = {
        "uniform": rng.integers(1, 1000, 300).tolist(),
        "few values": rng.choice([10, 20, 5000], 400).tolist(),
        "heavy tail": (rng.pareto(0.6, 300) * 10 + 1).astype(int).tolist(),
        "zeros": [0] * 50 + [7] * 3 + [100],
        "narrow": (1000 + rng.integers(0, 3, 200)).tolist(),
        "two": [3, 900],
    }
    exact, loop = age(spark, groups, p, aoi.aoi_percentile), age(spark, groups, p, aoi.aoi_percentile_loop)
    for k, gaps in groups.items():
        assert exact[k] == pytest.approx(definition(gaps, p), rel=1e-9, abs=1e-9), k
        assert loop[k] == pytest.approx(older_loop(gaps, p), rel=1e-9, abs=1e-9), k
        assert exact[k] <= max(gaps)


def test_percentile_grows_with_p(spark):
    gaps = {"g": np.random.default_rng(1).integers(0, 500, 200).tolist()}
    ages = [age(spark, gaps, p, aoi.aoi_percentile)["g"] for p in (0.1, 0.5, 0.9, 0.99)]
    assert ages == sorted(ages)


def test_no_age_without_gaps(spark):
    df = spark.createDataFrame([("a", None), ("b", 0), ("c", 10**6)], "k string, gap_ns long")
    got = {r.k: (r.aoi_mean_ms, r.aoi_p95_ms) for r in aoi.aoi_mean_and_p95(df, ["k"]).collect()}
    assert got == {"c": (0.5, 0.95)}
    means = {r.k: r.aoi_mean_ms for r in aoi.aoi_mean(df, ["k"]).collect()}
    assert math.isnan(means["a"]) and math.isnan(means["b"]) and means["c"] == 0.5


def test_mean_beyond_exact_digits(spark):
    """Squares too large for 38 digits are added up as doubles instead of being lost."""
    gaps = [9 * 10**18] * 3 + [10**9]
    df = spark.createDataFrame([("g", g) for g in gaps], "k string, gap_ns long")
    want = sum(g * g for g in gaps) / (2 * sum(gaps)) / 1e6
    assert aoi.aoi_mean_and_p95(df, ["k"]).collect()[0].aoi_mean_ms == pytest.approx(want, rel=1e-12)
    assert aoi.aoi_mean(df, ["k"]).collect()[0].aoi_mean_ms == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("p", [0.0, 1.0])
def test_share_is_checked(spark, p):
    with pytest.raises(ValueError):
        aoi.aoi_percentile(spark.createDataFrame([("a", 1)], "k string, gap_ns long"), ["k"], p)


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_exact_percentile(spark, p):
    rng = np.random.default_rng(3)
    groups = {
        "normal": rng.normal(0, 5, 501).tolist(),
        "ties": rng.choice([0.0, 1.5, -2.0], 300).tolist(),
        "signed zero": [0.0, -0.0, -1.0, 1.0],
        "wide": [10.0**e for e in range(-300, 300, 7)] + [-(10.0**e) for e in range(-300, 300, 11)],
        "one": [4.25],
        "close": (1.0 + rng.random(200) * 1e-9).tolist(),
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("one", None), ("one", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.q for r in ranks.exact_percentile(df, ["k"], "v", p, "q").collect()}
    for k, vs in groups.items():
        assert got[k] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-300), k


def test_bins_keep_the_order_of_values(spark):
    values = sorted([0.0, 1e-310, 5e-324, 1.7e308, -1.7e308, -1e-310, 1.0, np.nextafter(1.0, 2), 2.0, -2.0, 3.5, -3.5])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    bins = [r.b for r in df.select("v", ranks.value_bin(df.v).alias("b")).orderBy("v").collect()]
    assert bins == sorted(bins)


@pytest.mark.parametrize("kept", [ranks.KEPT_ROWS, 1])
@pytest.mark.parametrize("p", [0.0, 0.3, 0.95, 1.0])
def test_percentile_of_neighbouring_doubles(spark, monkeypatch, kept, p):
    """Values that differ in their last bits, both signs and zeros, hugely repeated values: exact also where bins are divided."""
    monkeypatch.setattr(ranks, "KEPT_ROWS", kept)
    rng = np.random.default_rng(2)
    near = [1.0]
    for _ in range(60):
        near.append(np.nextafter(near[-1], 2))
    groups = {
        "near": near, "signs": [-5.0, -0.0, 0.0, 5.0, -1e-300, 1e300, -1.7e308, 1.7e308], "same": [3.5] * 500 + [3.5000001],
        "normal": rng.normal(size=300).tolist(), "one": [2.0],
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("one", math.nan), ("one", None), ("none", None)]
    got = {r.k: r.q for r in ranks.exact_percentile(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", p, "q").collect()}
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        rising = sorted(vs)
        at = p * (len(vs) - 1)
        low, high = rising[math.floor(at)], rising[min(math.floor(at) + 1, len(vs) - 1)]
        assert got[k] == low + (high - low) * (at - math.floor(at)), k


def test_only_bins_are_shuffled(spark):
    """200,000 different values of one bin: the exchange before the bins carries a row per bin and task, and none is keyed by value."""
    df = spark.range(0, 200_001, 1, 8).select(F.lit("g").alias("k"), (F.lit(1.0) + F.col("id") / 1e9).alias("v"))
    made = ranks.exact_percentile(df, ["k"], "v", 0.5, "q")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan or all("_v" not in line for line in plan.splitlines() if "hashpartitioning" in line)
    assert made.collect()[0].q == 1.0 + 100_000 / 1e9
