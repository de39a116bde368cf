"""AR(1) coefficients row by row, the front of many points, and accounts of copies that are forgotten."""

import math

import pytest
from pyspark.sql import functions as F

from tauflow.operators.ar1 import ar1_rls_update
from tauflow.operators.experiments import pareto_front
from tauflow.operators.sequence import ar1_rls_fit, cut_long_streams
from tauflow.streaming import collect

READING = "device_id string, sensor string, ts_ns long, seq long, x double"
KEYS, ORDER = ["device_id", "sensor"], ["ts_ns", "seq"]


def readings(spark):
    rows = [("a", "temp", i * 7 % 50, i, math.sin(i) + i % 5) for i in range(50)]
    rows += [("b", "temp", i, i, None if i in (3, 4) else 0.0 if i < 6 else float(i)) for i in range(20)]
    rows += [(None, "temp", 5, 1, 2.0), (None, "temp", 6, 2, 3.0), ("c", "temp", None, 1, 4.0)]
    return spark.createDataFrame(rows, READING)


def plain(rows, forgetting):
    out, streams = {}, {}
    for r in rows:
        streams.setdefault((r.device_id, r.sensor), []).append(r)
    for key, own in streams.items():
        up = down = 0.0
        before = None
        for r in sorted(own, key=lambda r: (r.ts_ns is not None, r.ts_ns or 0, r.seq)):
            both = r.x is not None and before is not None
            up = forgetting * up + (r.x * before if both else 0.0)
            down = forgetting * down + (before * before if both else 0.0)
            before = r.x
            a = up / down if down > 0 else 1.0
            out[key, r.seq] = (a, None if r.x is None else a * r.x)
    return out


@pytest.mark.parametrize("max_rows", [None, 8, 3])
@pytest.mark.parametrize("forgetting", [0.99, 0.3, 1.0])
def test_coefficient_after_every_reading(spark, max_rows, forgetting):
    df = readings(spark)
    expected = plain(df.collect(), forgetting)
    got = ar1_rls_update(cut_long_streams(df, KEYS, max_rows=max_rows), KEYS, ORDER, "x", forgetting).collect()
    assert len(got) == len(expected) == 73
    for r in got:
        a, forecast = expected[(r.device_id, r.sensor), r.seq]
        assert r.a == pytest.approx(a, rel=1e-9)
        assert (r.forecast is None or math.isnan(r.forecast)) if forecast is None else r.forecast == pytest.approx(forecast, rel=1e-9)


def test_last_coefficient_is_that_of_the_fit(spark):
    df = readings(spark).where("device_id = 'a'")
    last = ar1_rls_update(df, KEYS, ORDER, "x").orderBy(F.desc("ts_ns")).first()
    assert ar1_rls_fit(df, KEYS, ORDER, "x").first().a == pytest.approx(last.a, rel=1e-9)


def test_no_readings(spark):
    assert ar1_rls_update(readings(spark).limit(0), KEYS, ORDER, "x").count() == 0


def test_front_of_many_points(spark):
    """A front of 4,000 points in one group, as many points behind it, ties, and a group without a name."""
    n = 4000
    points = spark.range(2 * n).select(
        F.when(F.col("id") % 7 == 0, None).otherwise("temp").alias("sensor"), "id",
        (F.col("id") % n).cast("double").alias("rate_Bps"),
        (n - F.col("id") % n + F.when(F.col("id") >= n, F.col("id") % 3).otherwise(0)).cast("double").alias("aoi_mean_ms"))
    rows = points.collect()
    least, expected = {}, set()
    for r in sorted(rows, key=lambda r: (r.rate_Bps, r.aoi_mean_ms)):
        bound = least.get(r.sensor, (math.inf, -1.0))
        if r.aoi_mean_ms < bound[0] or (r.aoi_mean_ms, r.rate_Bps) == bound:
            least[r.sensor] = (r.aoi_mean_ms, r.rate_Bps)
            expected.add(r.id)
    front = pareto_front(points, ["sensor"])
    assert sorted(r.id for r in front.collect()) == sorted(expected)
    assert pareto_front(points.limit(0), ["sensor"]).count() == 0


def test_final_accounts_are_given_once_and_forgotten(spark, tmp_path):
    """One file for each micro-batch; each event comes twice in a row of batches, a very late copy is left out."""
    hour = 3_600_000_000_000
    schema = "device_id string, sensor string, seq long, ts_ns long, t_recv_ns long, mqtt_bytes long"
    at = lambda i: (400_000 + i) * hour
    batches = [[("d", "temp", i, at(i), at(i) + 1, 10), ("d", "temp", max(i - 1, 0), at(max(i - 1, 0)), at(i) + 2, 7)] for i in range(12)]
    batches[11].append(("d", "temp", 2, at(2), at(11) + 3, 99))
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = collect.write_log_stream(collect.stream_final_accounts(stream, "3 hours"), str(tmp_path / "out"), str(tmp_path / "check"), None)
    query.awaitTermination()
    got = {r.seq: (r.first_bytes, r.mqtt_size_bytes, r.copies_dropped) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: (10, 24, 2), **{i: (10, 17, 1) for i in range(1, 9)}}
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress) <= 5
