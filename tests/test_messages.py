"""Message text, sizes, rules, quantizer, readings."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tauflow.functions import quantize, signals, wire
from tauflow.operators import packets, validate
from tauflow.sources import messages


def test_number_text_is_what_json_writes(spark):
    rng = random.Random(5)
    values = [0.0, -0.0, 1.0, -1.5, 1e7, 1.25e7, 123456789.125, 1e15, 9999999.0, 1e-3, 1.5e-3, 1e-4, 1.25e-4, 1e-5,
              9.999e-5, -3e-7, 1.5e-300, 0.1, 0.30000000000000004, -2.5e8, 1e100, 1e-100]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-20, 16) for _ in range(3000)]
    df = spark.createDataFrame([(v, json.dumps(v)) for v in values], "v double, t string")
    wrong = df.where((wire.float_text(F.col("v")) != F.col("t")) | (wire.float_length(F.col("v")) != F.length("t")))
    assert wrong.collect() == []


def test_event_text_is_what_json_writes(spark):
    names = ["dev-1", 'q"uote', "back\\slash", "tab\tline\n", "ctl\x01\x1f", "한국어", "é🙂", "del\x7f"]
    rows = [
        dict(ts=i, seq=i * 7, device_id=n, sensor="temp", val=0.1 * i, pred=-1e-7, res=1e9, tau=0.2, kbits=8,
             profile="delay_loss", policy="adaptive")
        for i, n in enumerate(names)
    ]
    columns = list(rows[0])
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "ts long, seq long, device_id string, sensor string,"
                               "val double, pred double, res double, tau double, kbits int, profile string, policy string")
    assert df.columns == columns
    got = df.orderBy("ts").select(wire.event_json(ts="ts").alias("j"), wire.event_json_bytes(ts="ts").alias("n")).collect()
    for r, want in zip(got, rows):
        text = json.dumps(want, ensure_ascii=False, separators=(",", ":"))
        assert json.loads(r.j) == want
        assert r.n == len(text.encode())


def test_length_bytes_at_the_limits(spark):
    sizes = [0, 127, 128, 16383, 16384, 2097151, 2097152, 268435455, 268435456, -1]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i int, s long")
    got = [r.n for r in df.orderBy("i").select(wire.remaining_length_bytes(F.col("s")).alias("n")).collect()]
    assert got == [1, 1, 2, 2, 3, 3, 4, 4, None, None]


def test_payloads_that_cannot_be_read(spark):
    good = dict(ts=5, seq=2**64 - 1, device_id="d", sensor="temp", val=1, pred="2.5", res=0.5, tau=0.2, kbits=8.9,
                profile="delay_loss", policy="periodic", aoi_ms=None)
    payloads = {
        "good": json.dumps(good),
        "array": "[1]",
        "cut": json.dumps(good)[:-1],
        "two missing": json.dumps({k: v for k, v in good.items() if k not in ("tau", "seq")}),
        "text": json.dumps({**good, "kbits": "x"}),
        "two rules": json.dumps({**good, "device_id": "a/b", "kbits": 17}),
        "nan": json.dumps({**good, "val": float("nan")}),
        "late aoi": json.dumps({**good, "aoi_ms": -1}),
    }
    rows = [(k, "edge/d/temp/event", p, 1, False, False, 9) for k, p in payloads.items()]
    rows.append(("other topic", "edge/d/event", json.dumps(good), 1, False, False, 9))
    df = spark.createDataFrame(rows, "name string, topic string, payload string, qos int, dup boolean, retain boolean, t_recv_ns long")
    got = {r["name"]: r for r in messages.event_stream(df).collect()}
    assert set(got) == set(payloads)
    problems = {k: list(r.problems) for k, r in got.items()}
    assert problems["good"] == [] and int(got["good"].seq) == 2**64 - 1
    assert (got["good"].val, got["good"].pred, got["good"].kbits) == (1.0, 2.5, 8)
    assert problems["array"] == problems["cut"] == ["not a JSON object"]
    assert sorted(problems["two missing"]) == ["seq missing from message", "tau missing from message"]
    assert problems["text"] == ["no kbits"]
    assert problems["two rules"] == ["device_id with /", "kbits out of range"]
    # NaN is no JSON; as a number it would be refused all the same.
    assert problems["nan"] == ["not a JSON object"]
    assert problems["late aoi"] == ["aoi_ms negative"]
    assert validate.accepted(messages.event_stream(df)).count() == 1


def test_topic_rules(spark):
    topics = ["a/b", "", "a/+", "#", "x" * 65535, "x" * 65536, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(topics)], "i int, t string").orderBy("i")
    got = [list(r.p) for r in df.select(validate.topic_problems(F.col("t")).alias("p")).collect()]
    assert got == [[], ["topic empty"], ["topic with wildcard"], ["topic with wildcard"], [], ["topic too long"], ["topic empty"]]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.floats(-100, 100), st.integers(1, 16)), min_size=1, max_size=40))
def test_quantize_and_back(spark, rows):
    df = spark.createDataFrame(rows, "x double, k int")
    lo, hi = F.lit(-80.0), F.lit(0.0)
    z = df.withColumn("z", quantize.quantize(F.col("x"), F.col("k"), lo, hi)).select("x", "k", "z.*")
    z = z.withColumn("back", quantize.dequantize(F.col("code"), F.col("k"), lo, hi))
    for r in z.collect():
        assert r.back == r.q and 0 <= r.code < 2**r.k
        assert r.saturated == (r.x <= -80 or r.x >= 0)
        assert abs(min(max(r.x, -80.0), 0.0) - r.q) <= r.step / 2 + 1e-9


def test_quantizer_limits(spark):
    df = spark.createDataFrame([(0.5, 0), (0.5, 17), (float("nan"), 8), (float("inf"), 8), (0.5, 8)], "x double, k int")
    z = df.select(quantize.quantize(F.col("x"), F.col("k"), F.lit(0.0), F.lit(1.0)).getField("code").alias("c")).collect()
    assert [r.c for r in z] == [None, None, None, None, 128]


def test_raw_temperature_text(spark):
    texts = {
        "aa YES\nbb t=21562": (21.562, True), "aa NO\nbb t=-125": (-0.125, False), "aa YES": (None, False),
        "aa YES\nbb 21562": (None, False), "aa YES\nbb t=x": (None, False), "\naa YES\r\nbb t=1000\n": (1.0, True), "": (None, False),
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: (r.z.celsius, r.z.valid) for r in df.select("t", signals.one_wire_reading(F.col("t")).alias("z")).collect()}
    assert got == texts
    plain = {"43750\n": (43.75, True), " 21.5 ": (21.5, True), "200": (200.0, True), "200.5": (0.2005, True), "n/a": (None, False), "": (None, False)}
    df = spark.createDataFrame([(t,) for t in plain], "t string")
    got = {r.t: (r.z.celsius, r.z.valid) for r in df.select("t", signals.plain_reading(F.col("t")).alias("z")).collect()}
    assert got == plain


def test_frame_level(spark):
    frames = [[0, 0], [16384, -16384], [-32768, 32767], []]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(frames)], "i int, f array<smallint>").orderBy("i")
    got = [tuple(r.l) for r in df.select(signals.frame_level(F.col("f")).alias("l")).collect()]
    assert got[0] == (-240.0, 0.0)
    assert got[1][0] == pytest.approx(-6.0206, abs=1e-4)
    # The lowest sample counts as clipped.
    assert got[2][1] == 1.0 and got[3] == (None, None)


def test_clock_drift(spark):
    df = spark.createDataFrame([(0.0, 10.0), (10.0, 0.0), (1.0, 0.0)], "s double, r double")
    pushed = [r.d.action for r in df.select(signals.clock_drift(df.s, df.r, 1.0, True).alias("d")).collect()]
    assert pushed == ["step_system", "step_rtc", "none"]
    off = [r.d.action for r in df.select(signals.clock_drift(df.s, df.r, 1.0).alias("d")).collect()]
    assert off == ["step_system", "step_system", "none"]


def test_recorded_sizes_are_kept_row_by_row(spark):
    rows = [("dev-1", "mic_rms", i, 10**18 + i, 1.0, 1.0, 0.0, 3.0, 6, "slow_10kbps", "periodic", 100 if i < 4 else None) for i in range(8)]
    names = "device_id string, sensor string, seq long, ts_ns long, val double, pred double, res double, tau double, kbits int, profile string, policy string"
    df = spark.createDataFrame(rows, f"{names}, mqtt_bytes int")
    computed = {r.seq: r.mqtt_bytes for r in packets.with_event_bytes(df.drop("mqtt_bytes")).collect()}
    got = {r.seq: r.mqtt_bytes for r in packets.with_event_bytes(df).collect()}
    assert got == {i: 100 if i < 4 else computed[i] for i in range(8)} and computed[5] > 100


def test_no_work_folder_without_a_setting_on_a_cluster():
    from types import SimpleNamespace

    from tauflow.session import work_folder

    unset = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(getConf=lambda: unset, master="yarn", applicationId="x")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_folder(SimpleNamespace(conf=unset, sparkContext=context), "logs")
