"""Queries on tables larger than the test tables."""

import duckdb
from pyspark.sql import functions as F

from tauflow.functions import wire
from tauflow.operators import aoi, delta, experiments
from tauflow.operators.trigger import Trigger
from tauflow.plans import oracle, queries
from tauflow.plans.queries import QUERIES
from tauflow.streaming import buckets
from tests.check import differences


def test_length_bytes_of_sizes_beyond_64_bits(spark, tmp_path):
    lengths = [(3, 200_000), (7, 100), (2, 200_000), (11, 55_108), (15, 55_109)]
    spark.createDataFrame(lengths, "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.size, r.n) for r in QUERIES["remaining_length_bytes"](spark, str(tmp_path)).collect()}
    assert got[3] == got[15] == (None, None)
    assert got[7] == (100**4, 4) and got[2] == (200_000**3, None) and got[11][1] is None and got[11][0] > 9 * 10**18


def test_length_bytes_of_sizes_beyond_53_bits(spark, tmp_path):
    """Powers that no double holds are rounded as the SQL rounds them, ties of both directions among them."""
    n = F.col("id")
    fourth = spark.range(9_700, 55_109).select((4 * n + 3).alias("doc_id"), n.alias("n_chars"))
    third = spark.range(5_400, 55_109).select((4 * n + 2).alias("doc_id"), (38 * n + 1).alias("n_chars"))
    odd = [(0, None), (None, 5), (None, 1), (-1, None), (-2, 2), (-4, 0), (1, 0), (3, -30_165), (5, 3_037_000_499), (6, 2_097_151)]
    rows = fourth.union(third).union(spark.createDataFrame(odd, "doc_id long, n_chars long"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert differences(QUERIES["remaining_length_bytes"](spark, str(tmp_path)), con, oracle.oracle_sql()["remaining_length_bytes"]) == []


def test_length_bytes_of_sizes_without_a_number(spark, tmp_path):
    """The SQL ends with an error at these: 2^63 is the least that does not fit, zero has no negative power."""
    rows = spark.createDataFrame([(2, 2_097_152), (-2, 0)], "doc_id long, n_chars long")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.size, r.n) for r in QUERIES["remaining_length_bytes"](spark, str(tmp_path)).collect()] == [(None, None)] * 2


def test_start_states_cost_nothing_per_stream(spark):
    """Slices of many streams go through Python in batches, each pass once, streams of unknown devices among them."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 50 > 0, F.concat(F.lit("d"), F.col("id") % 50)).alias("device_id"), F.lit("temp").alias("sensor"),
        (F.col("id") * 1_000_000_000).alias("ts_ns"), F.col("id").alias("seq"), F.sin(F.col("id") * F.col("id")).alias("x"))
    settings = [Trigger(alpha=0.9, tau=0.8, kbits=8, heartbeat_s=400), Trigger(alpha=0.2, tau=1.2, kbits=8, heartbeat_s=None)]
    cut = delta.send_on_delta(rows, settings, max_rows=7)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and plan.count("MapInArrow") <= 3
    whole = delta.send_on_delta(rows, settings, max_rows=None)
    assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))


def test_swept_settings_are_the_same_when_streams_are_cut(spark, sf_dir):
    cut, whole = (delta.send_on_delta(queries.views.samples(spark, sf_dir), queries.SWEEP, max_rows=n) for n in (3, None))
    assert "FlatMapGroupsInPandas" not in cut._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))


def test_running_ages_of_many_streams_in_a_state(spark, sf_dir, monkeypatch):
    """Streams that share a state, micro-batches of several files: the same ages."""
    expected = sorted(map(str, QUERIES["stream_aoi"](spark, sf_dir).collect()))
    monkeypatch.setattr(buckets, "BUCKETS", 3)
    monkeypatch.setattr(queries, "FILE_ROWS", 40)
    assert sorted(map(str, QUERIES["stream_aoi"](spark, sf_dir).collect())) == expected


def test_policies_of_many_streams_in_a_state(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(buckets, "BUCKETS", 3)
    got = sorted(map(str, QUERIES["stream_bandit"](spark, sf_dir).collect()))
    assert got == sorted(map(str, QUERIES["bandit_replay"](spark, sf_dir).collect()))


def test_a_sweep_cuts_its_streams_once(spark, monkeypatch):
    """Events keep the slices of their readings; equal times, copies and readings without a time change nothing."""
    n = F.col("id")
    rows = spark.range(400).select(
        F.concat(F.lit("d"), n % 3).alias("device_id"), F.when(n % 2 == 0, "temp").otherwise("mic_rms").alias("sensor"),
        (F.floor(n / 9) * 1_000_000_000).alias("ts_ns"), (n - F.when(n % 17 == 0, 12).otherwise(0)).alias("seq"),
        (F.sin(n * n) * 20).alias("x"), F.lit("slow_10kbps").alias("profile"))
    settings = [Trigger(alpha=0.9, tau=9.0, kbits=8, heartbeat_s=4, name="a"), Trigger(alpha=0.9, tau=0.0, kbits=6, policy="periodic", name="b")]
    whole = sorted(map(str, queries._rounded_summary(experiments.policy_sweep(rows, settings, max_rows=None)).collect()))

    def never(*_):
        raise AssertionError("cut again")

    monkeypatch.setattr(aoi, "cut_long_streams", never)
    cut = queries._rounded_summary(experiments.policy_sweep(rows, settings, max_rows=4))
    assert len(whole) == 4 and sorted(map(str, cut.collect())) == whole


def test_pooled_gaps_across_slices(spark):
    times = [(k, t) for k in ("a", None) for t in (None, 7, 1, 1, 3, 20, 21, 22, 22, 50, -4)]
    rows = spark.createDataFrame(times, "device_id string, ts_ns long")
    expected = sorted(2 * [5, 0, 2, 4, 13, 1, 1, 0, 28])
    for most in (None, 1, 3, 100):
        assert sorted(r.gap_ns for r in aoi.pooled_gaps(rows, ["device_id"], max_rows=most).collect()) == expected


def test_first_slices_row_by_row_or_by_arrays(spark, monkeypatch):
    rows = spark.range(300).select(
        F.lit("d").alias("device_id"), F.lit("temp").alias("sensor"), (F.col("id") * 1_000_000_000).alias("ts_ns"),
        F.col("id").alias("seq"), F.sin(F.col("id") * F.col("id")).alias("x"))
    settings = [Trigger(alpha=0.9, tau=t, kbits=8, heartbeat_s=h, bootstrap=b, min_emit_interval_ms=g)
                for t, h, b, g in ((0.8, 40, True, 0), (5.0, None, False, 0), (5.0, None, True, 0), (0.5, 7, False, 3000))]
    whole = sorted(map(str, delta.send_on_delta(rows, settings, max_rows=None).collect()))
    for few in (0, delta._FEW_ROWS):
        monkeypatch.setattr(delta, "_FEW_ROWS", few)
        assert sorted(map(str, delta.send_on_delta(rows, settings, max_rows=50).collect())) == whole


def test_length_of_pooled_texts(spark):
    texts = ['plain', 'q"uo\\te', 'tab\tand\x01\x1f', 'ümlaut \U0001f600', '']
    rows = spark.createDataFrame([(t, u, None if i == 4 else "x") for i, t in enumerate(texts) for u in texts], "a string, b string, c string")
    quoted = F.octet_length(F.concat(*[wire._json_string(F.col(c)) for c in "abc"]))
    got = rows.select("c", quoted.alias("n"), wire._text_length(F.concat("a", "b", "c")).alias("m")).collect()
    assert all(r.m == (r.n - 6 if r.c else None) for r in got)
