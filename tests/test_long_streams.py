"""One device holds half of all rows; cutting its stream into slices must not change any result."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tauflow.operators import aoi, delta, reconstruct, sequence
from tauflow.operators.delta import last_sent_steps
from tauflow.operators.summary import summarize
from tauflow.operators.trigger import Trigger, replay
from tauflow.plans import views
from tauflow.schemas import STREAM

ORDER = ("ts_ns", "seq")
CUT = 25


@pytest.fixture(scope="module")
def hot(spark, sf_dir):
    rows = views.samples(spark, sf_dir)
    device = F.when(F.col("seq") % 2 == 0, "dev-hot").otherwise(F.col("device_id"))
    # Some equal times, and failed readings at the start of streams.
    return (
        rows.withColumn("device_id", device)
        .withColumn("ts_ns", F.when(F.col("seq") % 5 == 0, F.floor(F.col("ts_ns") / 10**13) * 10**13).otherwise(F.col("ts_ns")))
        .withColumn("valid", F.col("seq") % 3 != 0)
        .withColumn("policy", F.lit("fixed_tau"))
        .withColumn("profile", F.lit("delay_loss"))
        .cache()
    )


def both(make, digits=9):
    def plain(df):
        return sorted(
            tuple(round(v, digits) if isinstance(v, float) else str(v) for v in row) for row in df.collect()
        )

    whole, cut = make(None), make(CUT)
    assert plain(whole) == plain(cut)
    return whole


def slice_sizes(df, max_rows):
    cut = sequence.cut_long_streams(df, STREAM, max_rows=max_rows)
    assert cut.count() == df.count()
    return cut.groupBy(*STREAM, sequence.SLICE).agg(
        F.count("*").alias("n"), F.min("ts_ns").alias("from"), F.max("ts_ns").alias("to")).orderBy(*STREAM, sequence.SLICE).collect()


def test_hot_stream_is_cut(hot):
    # All rows of one point of time stay together, here up to some ten.
    sizes = [r.n for r in slice_sizes(hot, CUT) if r.device_id == "dev-hot"]
    assert len(sizes) >= 18 and max(sizes) <= 2 * CUT


def test_slices_by_rows_not_by_time(spark):
    """Steady rate, bursts inside bursts, one clock at 0 and one far ahead, a null time: no slice above twice the limit."""
    start = 1_700_000_000_000_000_000
    n = F.col("id")
    times = (
        F.when(n == 0, 0).when(n == 1, 4 * 10**18).when(n == 2, F.lit(None)).when(n < 3000, start + n * 10**12)
        .when(n < 9000, start + 10**15 + n * 1000).when(n < 12_000, start + 10**15 + 5_000_000 + n).otherwise(start + n)
    )
    df = spark.range(20_000).select(
        times.cast("bigint").alias("ts_ns"), n.alias("seq"), F.when(n % 2 == 0, "even").alias("device_id"), F.lit("temp").alias("sensor"))
    limit = 100
    slices = slice_sizes(df, limit)
    assert max(r.n for r in slices) <= 2 * limit
    assert len(slices) <= 2 * 20_000 / limit
    for a, b in zip(slices, slices[1:]):  # in order of time, without overlap
        if a.device_id == b.device_id and b["from"] is not None and a["to"] is not None:
            assert a["to"] < b["from"]


def test_equal_times_stay_together(spark):
    df = spark.range(1000).select(F.lit(5).alias("ts_ns"), F.col("id").alias("seq"), F.lit("d").alias("device_id"), F.lit("temp").alias("sensor"))
    assert [r.n for r in slice_sizes(df, 10)] == [1000]


def test_short_streams_are_left_alone(hot):
    assert sequence.cut_long_streams(hot, STREAM, max_rows=10**6).columns == hot.columns


@pytest.mark.parametrize("operator", [
    lambda d: sequence.with_previous(d, STREAM, ORDER, {"x": "x1", "ts_ns": "t1"}),
    lambda d: sequence.with_last_known(d, STREAM, ORDER, F.when(F.col("seq") % 40 == 0, F.col("x")), "known"),
    lambda d: sequence.with_row_index(d, STREAM, ORDER, "n", start=7),
    lambda d: sequence.with_row_index(d, STREAM, ORDER, "n", newest_first=True),
    lambda d: sequence.carry_forward(d, STREAM, ORDER, "x", "valid", "shown"),
    lambda d: sequence.persistence_forecast(d, STREAM, ORDER, "x"),
    lambda d: sequence.ar1_rls_fit(d, STREAM, ORDER, "x"),
])
def test_sequence_operators(hot, operator):
    both(lambda n: operator(sequence.cut_long_streams(hot, STREAM, max_rows=n)).drop(sequence.SLICE))


def test_gaps(hot):
    both(lambda n: aoi.event_gaps(hot, STREAM, max_rows=n))


def test_reconstruct(hot):
    sent = hot.where("seq % 7 = 0").withColumn("val", F.col("x") + 1)
    both(lambda n: reconstruct.reconstruct_hold(hot, sent, max_rows=n).select("seq", "x", "restored"))


def test_summary(hot):
    events = hot.select("*", F.col("x").alias("val"), F.col("x").alias("pred"), F.abs("x").alias("res"),
                        F.lit(0.5).alias("tau"), F.lit(8).alias("kbits"))
    both(lambda n: summarize(events, max_rows=n), digits=6)


DAY_S = 86_400
SETTINGS = [
    Trigger(0.2, 15.0, 6, heartbeat_s=2 * DAY_S),
    Trigger(0.5, 10.0, 8, heartbeat_s=3600.0, min_emit_interval_ms=5e7),
    Trigger(0.05, 1e9, 8, heartbeat_s=3 * DAY_S),
    Trigger(0.9, 12.0, 4, heartbeat_s=None, bootstrap=False, min_emit_interval_ms=3e8),
    Trigger(0.3, 1.0, 8, policy="periodic"),
    Trigger(0.3, 70.0, 8, heartbeat_s=None, bootstrap=False, sensor="temp"),
]


def exactly(sent):
    columns = [*STREAM, "ts_ns", "seq", "setting", "val", "pred", "res", "reason"]
    return sorted(tuple(repr(v) for v in r) for r in sent.select(*columns).collect())


def test_send_on_delta(hot):
    whole = delta.send_on_delta(hot, SETTINGS, valid="valid", max_rows=None)
    expected = exactly(whole)
    for n in (CUT, 100):
        assert exactly(delta.send_on_delta(hot, SETTINGS, valid="valid", max_rows=n)) == expected
    assert {r.setting for r in whole.select("setting").distinct().collect()} >= {0, 1, 2, 3, 4}


def test_slices_of_a_long_stream_give_the_same_bits(spark):
    """Times near 1.7e18 ns, heartbeats of exactly ten spacings, slices long enough to run on their own."""
    rng = np.random.default_rng(5)
    x = np.cumsum(rng.normal(0, 0.3, 6000)).round(3).tolist()
    rows = [("dev-a", "temp", 1_700_000_000_000_000_001 + i * 1_000_001_000, 2**53 + 1 + i, v, None if i % 7 else 2**60 + i) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "device_id string, sensor string, ts_ns long, seq long, x double, extra long")
    settings = [Trigger(0.2, 1.5, 8, heartbeat_s=10.00001), Trigger(0.5, 1e9, 8, heartbeat_s=10.00001), Trigger(0.3, 0.9, 8, heartbeat_s=None)]
    expected = exactly(delta.send_on_delta(df, settings, max_rows=None))
    for n in (25, 1500, 4000):
        cut = delta.send_on_delta(df, settings, max_rows=n)
        assert exactly(cut) == expected
        assert all(r.extra is None or r.extra == 2**60 + r.seq - 2**53 - 1 for r in cut.select("extra", "seq").collect())


@pytest.mark.parametrize("seed", range(8))
def test_last_sent_steps_follow_the_step(seed):
    """What a slice's step function says about its last message is what running the slice gives."""
    rng = np.random.default_rng(seed)
    times = np.sort(rng.integers(10**9, 10**12, 60))
    values = rng.normal(0, 2, 60).tolist()
    for t in SETTINGS[:4] + [Trigger(0.4, 2.0, 8, heartbeat_s=50.0, min_emit_interval_ms=80_000)]:
        forecast, exceeds, f = 0.3, [], 0.3
        for x in values:
            exceeds.append(abs(x - f) > t.tau)
            f = t.alpha * x + (1 - t.alpha) * f
        until, sent = last_sent_steps(t, times, np.array(exceeds), False)
        for before in [int(b) for b in rng.integers(0, times[0], 20)] + [int(times[0])]:
            *_, last = replay(t, times.tolist(), values, forecast, before)
            step = int(np.searchsorted(until, before))
            assert last == (int(sent[step]) if step < len(until) else before)


def test_larger_tau_triggers_on_fewer_residuals(hot):
    small, large = Trigger(0.2, 5.0, 8), Trigger(0.2, 9.0, 8)
    sent = delta.send_on_delta(hot, [small, large], max_rows=None).where("reason = 'residual'")
    by = {i: {r.seq for r in sent.where(F.col("setting") == i).collect()} for i in (0, 1)}
    assert by[1] <= by[0] and by[1] != by[0]


@pytest.mark.parametrize("bad", [{"alpha": 0.0}, {"alpha": 1.5}, {"tau": -1.0}, {"min_emit_interval_ms": -1}, {"kbits": 0}])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        Trigger(**{"alpha": 0.5, "tau": 1.0, "kbits": 8, **bad})
