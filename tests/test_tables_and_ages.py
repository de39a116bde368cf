"""Replacing tables as a whole; the running age of streams against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tauflow.sinks import tables
from tauflow.streaming import age, collect


def log(spark, n, val=1.0):
    return spark.range(n).select(
        F.concat(F.lit("dev-"), F.col("id") % 3).alias("device_id"), F.lit("temp").alias("sensor"), F.lit("delay_loss").alias("profile"),
        F.lit("periodic").alias("policy"), F.col("id").alias("seq"), F.col("id").alias("ts_ns"), F.lit(val).alias("val"))


def names(folder):
    return sorted(p.name for p in folder.iterdir())


def test_a_new_log_takes_the_old_ones_place(spark, tmp_path):
    path = f"{tmp_path}/log"
    tables.write_event_log(log(spark, 5), path)
    tables.write_event_log(log(spark, 9, 2.0), path)
    assert tables.read_log(spark, path).where("val = 2.0").count() == 9
    assert names(tmp_path) == ["log"]


def test_a_failed_write_leaves_the_old_log(spark, tmp_path):
    path = f"{tmp_path}/log"
    tables.write_event_log(log(spark, 5), path)
    broken = log(spark, 1000, 2.0).withColumn("val", F.when(F.col("seq") == 990, F.raise_error(F.lit("lost"))).otherwise(2.0).cast("double"))
    with pytest.raises(Exception, match="lost"):
        tables.write_event_log(broken, path)
    assert tables.read_log(spark, path).where("val = 1.0").count() == 5
    assert names(tmp_path) == ["log"]


def test_a_log_may_be_replaced_by_what_is_read_from_it(spark, tmp_path):
    path = f"{tmp_path}/log"
    tables.write_decision_log(log(spark, 6), path)
    tables.write_decision_log(tables.read_log(spark, path).where("seq < 4"), path)
    assert tables.read_log(spark, path).count() == 4


def test_killed_between_the_renames(spark, tmp_path):
    path = f"{tmp_path}/log"
    tables.write_decision_log(log(spark, 6), path)
    (tmp_path / "log").rename(tmp_path / ".log.old-1")
    assert tables.read_log(spark, path).count() == 6
    (tmp_path / "log").rename(tmp_path / ".log.old-2")
    tables.write_decision_log(log(spark, 2), path)
    assert tables.read_log(spark, path).count() == 2
    assert names(tmp_path) == ["log"]


def test_bins_keep_order_and_width():
    rng = random.Random(1)
    for gap in [0, 1, 1023, 1024, 2047, 2048, 2**40 + 1, 2**62 + 12345, *(rng.randrange(1 << rng.randrange(1, 63)) for _ in range(500))]:
        low = age.bin_low(gap)
        assert low <= gap <= age.bin_high(low) and age.bin_high(low) - low <= gap / 1000
        assert age.bin_low(age.bin_high(low)) == low and age.bin_low(age.bin_high(low) + 1) == age.bin_high(low) + 1


def test_histogram_percentile():
    rng = random.Random(2)
    for gaps in ([5], [0, 0], [rng.randrange(1, 10**9) for _ in range(300)], [10**6] * 50 + [10**9] * 3):
        bins = {}
        for g in gaps:
            c, s = bins.get(age.bin_low(g), (0, 0))
            bins[age.bin_low(g)] = c + 1, s + g
        got = age.histogram_percentile(list(bins), [c for c, _ in bins.values()], [s for _, s in bins.values()])
        if not sum(gaps):
            assert got is None
            continue
        low, high = 0.0, float(max(gaps))
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(mid, g) for g in gaps) < 0.95 * sum(gaps) else (low, mid)
        assert math.isclose(got, high, rel_tol=2e-3)


def test_running_age_over_batches(spark, tmp_path):
    """Seven micro-batches, clocks that go back, streams of one event, a stream that is silent for some batches."""
    rng = random.Random(4)
    rows, clock = [], 0
    for i in range(700):
        clock += rng.choice([1, 10**6, 5 * 10**9, -10**6])
        rows.append((rng.choice("ab") if i < 300 else "b", i, i, clock))
    rows.append(("single", 700, 700, 5))
    for k in range(7):
        spark.createDataFrame(rows[k * 100 : (k + 1) * 100 + (k == 6)], "device_id string, t_recv_ns long, seq long, ts_ns long").coalesce(1) \
            .write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("device_id string, t_recv_ns long, seq long, ts_ns long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    collect.write_accounting_stream(age.stream_age(stream, ["device_id"]), f"{tmp_path}/out", f"{tmp_path}/cp", None).awaitTermination()
    assert len([n for n in names(tmp_path / "out") if n.startswith("batch_id=")]) == 7
    got = {r.device_id: r for r in collect.latest_accounts(spark, f"{tmp_path}/out", ["device_id"]).collect()}
    for device in ("a", "b", "single"):
        times = [r[3] for r in rows if r[0] == device]
        gaps = [b - a for a, b in zip(times, times[1:]) if b >= a]
        assert (got[device].n_gaps, got[device].last_ts_ns) == (len(gaps), times[-1])
        if gaps:
            assert math.isclose(got[device].aoi_mean_ms, sum(g * g for g in gaps) / (2 * sum(gaps)) / 1e6, rel_tol=1e-12)
    assert got["single"].aoi_mean_ms is None and got["single"].aoi_p95_ms is None


def test_a_flush_every_so_many_seconds(spark, tmp_path):
    """The collector's own trigger, not one bounded run: rows that come while it runs are flushed, and no flush writes twice."""
    log(spark, 3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(log(spark, 0).schema).parquet(f"{tmp_path}/in")
    running = collect.write_log_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp", flush_s=1)
    try:
        running.processAllAvailable()
        assert spark.read.parquet(f"{tmp_path}/out").count() == 3
        log(spark, 4).write.mode("append").parquet(f"{tmp_path}/in")
        running.processAllAvailable()
        assert spark.read.parquet(f"{tmp_path}/out").count() == 7
    finally:
        running.stop()
