"""Files, reports, streaming, policy, plans."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tauflow.operators import backlog, bandit, experiments
from tauflow.operators.dedup import dedup_first
from tauflow.operators.delta import send_on_delta
from tauflow.operators.trigger import Trigger
from tauflow.plans import views
from tauflow.plans.run_report import run_report
from tauflow.schemas import STREAM
from tauflow.sinks.reports import digest_lines, report_lines
from tauflow.sources.files import discover_inputs, read_events
from tauflow.streaming import collect, delta

SUMMARY = ("profile string, policy string, sensor string, n_events long, duration_s double, rate_Bps double, aoi_mean_ms double,"
           "aoi_p95_ms double, mae_event_mean double, mae_event_p95 double, kbits_mean double")


def log(spark, n=4, **fixed):
    rows = [(i * 10**9, i, "dev", "temp", 1.0, 1.0, 0.5, 0.2, 8, "delay_loss", "periodic") for i in range(n)]
    df = spark.createDataFrame(rows, "ts long, seq long, device_id string, sensor string, val double, pred double, res double,"
                               "tau double, kbits int, profile string, policy string")
    for c, v in fixed.items():
        df = df.withColumn(c, F.lit(v))
    return df


def write_file(df, folder, name, kind="parquet"):
    """One plain file, as a single-machine writer leaves it."""
    folder.mkdir(parents=True, exist_ok=True)
    if kind == "parquet":
        df.toPandas().to_parquet(folder / name)
    else:
        df.toPandas().to_csv(folder / name, index=False)


def test_input_rules(spark, tmp_path):
    write_file(log(spark), tmp_path / "a" / "run1", "events.parquet")
    write_file(log(spark), tmp_path / "a" / "run1", "other.parquet")
    write_file(log(spark), tmp_path / "b", "part.parquet")
    write_file(log(spark), tmp_path / "b", "part.csv", "csv")
    write_file(log(spark), tmp_path / "c", "log.csv", "csv")
    paths = [str(tmp_path / d) for d in "abc"]
    assert [(s.kind, s.pattern) for s in discover_inputs(spark, paths)] == [
        ("parquet", "events.parquet"), ("parquet", "*.parquet"), ("csv", "*.csv")]
    assert read_events(spark, paths).count() == 12
    # A file named again below its own directory is read once.
    assert read_events(spark, [paths[0], str(tmp_path / "a" / "run1" / "events.parquet"), paths[0]]).count() == 4
    with pytest.raises(FileNotFoundError):
        read_events(spark, [str(tmp_path / "none")])


def test_run_from_folder_name(spark, tmp_path):
    bare = log(spark).drop("profile", "policy")
    write_file(bare, tmp_path / "slow_10kbps__adaptive", "events.parquet")
    write_file(bare, tmp_path / "lte__adaptive", "events.parquet")
    got = {(r.profile, r.policy) for r in read_events(spark, [str(tmp_path)]).select("profile", "policy").collect()}
    assert got == {("slow_10kbps", "adaptive"), ("unknown", "unknown")}


def test_missing_columns_are_named(spark, tmp_path):
    write_file(log(spark).drop("tau", "policy"), tmp_path, "events.parquet")
    with pytest.raises(ValueError, match=r"missing columns: \['policy', 'tau'\]"):
        read_events(spark, [str(tmp_path)])


def test_one_file_without_a_column_is_named(spark, tmp_path):
    write_file(log(spark), tmp_path, "a.parquet")
    write_file(log(spark).drop("tau"), tmp_path / "old", "b.parquet")
    with pytest.raises(ValueError, match=r"old/b.parquet missing columns: \['tau'\]"):
        read_events(spark, [str(tmp_path)])
    # The one of the two run columns that a file lacks is not guessed.
    write_file(log(spark).drop("policy"), tmp_path / "slow_10kbps__adaptive", "events.parquet")
    with pytest.raises(ValueError, match=r"missing columns: \['policy'\]"):
        read_events(spark, [str(tmp_path / "slow_10kbps__adaptive")])


def test_csv_files_are_read_by_their_own_headers(spark, tmp_path):
    rows = log(spark).withColumn("seq", F.col("seq") + 100)
    write_file(log(spark), tmp_path, "a.csv", "csv")
    write_file(rows.select("seq", "sensor", *[c for c in rows.columns if c not in ("seq", "sensor")]), tmp_path, "b [1].csv", "csv")
    write_file(rows.withColumn("a, b", F.lit("1")).drop("profile", "policy"), tmp_path / "slow_10kbps__adaptive", "c.csv", "csv")
    (tmp_path / "empty.csv").write_text("")
    got = read_events(spark, [str(tmp_path)])
    assert sorted(r.seq for r in got.collect()) == [0, 1, 2, 3, 100, 100, 101, 101, 102, 102, 103, 103]
    assert {r.sensor for r in got.collect()} == {"temp"} and got.where("policy = 'adaptive'").count() == 4
    with pytest.raises(ValueError, match=r"d.csv missing columns: \['tau'\]"):
        write_file(log(spark).drop("tau"), tmp_path / "x", "d.csv", "csv")
        read_events(spark, [str(tmp_path)])


def test_only_empty_csv_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(FileNotFoundError):
        read_events(spark, [str(tmp_path)])


def test_collector_names_are_accepted(spark, tmp_path):
    renamed = log(spark).withColumnRenamed("ts", "ts_ns").withColumn("mqtt_size_bytes", F.lit(100))
    write_file(renamed, tmp_path, "events.parquet")
    out = run_report(spark, [str(tmp_path)], str(tmp_path / "out"), save_parquet=True)
    row = out.collect()[0]
    assert row.n_events == 4 and row.rate_Bps == pytest.approx(400 / 3)
    assert (tmp_path / "out" / "report.md").is_dir() and (tmp_path / "out" / "metrics_summary.parquet").is_dir()
    assert "rate=133.3 B/s" in spark.read.text(str(tmp_path / "out" / "digest.txt")).collect()[2][0]


def test_runs_of_one_device_are_kept_apart(spark, tmp_path):
    write_file(log(spark).drop("profile", "policy"), tmp_path / "slow_10kbps__periodic", "events.parquet")
    write_file(log(spark).drop("profile", "policy"), tmp_path / "slow_10kbps__adaptive", "events.parquet")
    out = run_report(spark, [str(tmp_path)], str(tmp_path / "out"))
    assert sorted((r.policy, r.n_events) for r in out.collect()) == [("adaptive", 4), ("periodic", 4)]
    assert dedup_first(read_events(spark, [str(tmp_path / "slow_10kbps__periodic"), str(tmp_path / "slow_10kbps__adaptive")])).count() == 4


def test_digest_and_report_text(spark):
    nan = float("nan")
    rows = [("slow_10kbps", "periodic", "mic", 42, 1.0, 12.34, 456.7, 890.1, 0.1234, 0.4567, 6.78),
            ("slow_10kbps", "fixed_tau", "temp", 12, nan, nan, nan, 1234.5, 0.2222, 0.3333, 8.0)]
    df = spark.createDataFrame(rows, SUMMARY)
    text = "\n".join(r.line for r in digest_lines(df, limit=1).orderBy("line_no").collect())
    for part in ("rate=12.3 B/s", "456.7 ms", "MAE=0.123", "Top 1 of 2", "Left out: 1"):
        assert part in text
    lines = [r.line for r in report_lines(df).orderBy("line_no").collect()]
    assert lines[-1].count("NaN") == 3 and "1234.5" in lines[-1]
    empty = [r.line for r in digest_lines(df.limit(0)).orderBy("line_no").collect()]
    assert len(empty) == 2 and empty[1] == "No rows to report."


def test_equal_points_stay_on_the_front(spark):
    points = [("a", 1.0, 9.0), ("b", 1.0, 9.0), ("c", 1.0, 10.0), ("d", 2.0, 9.0), ("e", 2.0, 5.0), ("f", 3.0, 5.0), ("g", 4.0, 1.0)]
    df = spark.createDataFrame([("s", *p) for p in points], "sensor string, name string, rate_Bps double, aoi_mean_ms double")
    assert sorted(r.name for r in experiments.pareto_front(df, ["sensor"]).collect()) == ["a", "b", "e", "g"]


def test_improvement_needs_a_number(spark):
    rows = [("p", pol, "s", 5, 1.0, rate, 10.0, 1.0, 1.0, 1.0, 8.0) for pol, rate in (("periodic", math.nan), ("adaptive", 4.0))]
    row = experiments.improvement_vs_baseline(spark.createDataFrame(rows, SUMMARY)).collect()[0]
    assert math.isnan(row.rate_gain_pct) and not row.rate_goal_met and row.aoi_gain_pct == 0.0


# ---- streaming over several batches


def test_copies_across_batches(spark, sf_dir, tmp_path):
    arrivals = views.arrivals(spark, sf_dir).select("device_id", "sensor", "seq", "ts_ns", "t_recv_ns", "copy_no", F.lit(10).alias("mqtt_bytes"))
    for copy in (0, 1):
        arrivals.where(F.col("copy_no") == copy).coalesce(1).write.parquet(str(tmp_path / "in" / f"batch{copy}"))
    source = lambda: spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    collect.write_log_stream(collect.stream_dedup(source()), str(tmp_path / "log"), str(tmp_path / "c1"), None).awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "log"))
    assert kept.count() == kept.dropDuplicates(["device_id", "sensor", "seq"]).count() == 1000
    accounts = collect.stream_dedup_accounting(source())
    collect.write_accounting_stream(accounts, str(tmp_path / "acc"), str(tmp_path / "c2"), None).awaitTermination()
    latest = collect.latest_accounts(spark, str(tmp_path / "acc"))
    totals = latest.agg(F.count("*"), F.sum("copies_dropped"), F.sum("mqtt_size_bytes")).collect()[0]
    assert tuple(totals) == (1000, 50, 10 * 1050)


def test_trigger_state_lasts_over_batches(spark, sf_dir, tmp_path):
    samples = views.samples(spark, sf_dir)
    settings = [Trigger(0.2, 15.0, 6, heartbeat_s=172_800.0), Trigger(0.5, 5.0, 8, min_emit_interval_ms=1e8)]
    edges = samples.approxQuantile("ts_ns", [0.33, 0.66], 0.01)
    third = F.when(F.col("ts_ns") < edges[0], 0).when(F.col("ts_ns") < edges[1], 1).otherwise(2)
    for i in range(3):
        samples.where(third == i).coalesce(1).write.parquet(str(tmp_path / "in" / f"batch{i}"))
    stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    sent = delta.stream_send_on_delta(stream, settings)
    collect.write_log_stream(sent, str(tmp_path / "out"), str(tmp_path / "c"), None).awaitTermination()
    columns = [*STREAM, "seq", "setting", "val", "pred", "res", "reason"]
    batch = send_on_delta(samples, settings).select(*columns)
    assert sorted(spark.read.parquet(str(tmp_path / "out")).select(*columns).collect()) == sorted(batch.collect())


# ---- policy


def test_safe_arm():
    arms = (bandit.Arm(2.0, 8), bandit.Arm(1.0, 4), bandit.Arm(1.0, 6))
    assert bandit.PolicyConfig(arms).safe_index == 2
    assert bandit.PolicyConfig(arms, safe_arm=bandit.Arm(2.0, 8)).safe_index == 0
    with pytest.raises(ValueError):
        bandit.PolicyConfig(arms, safe_arm=bandit.Arm(9.0, 8))
    with pytest.raises(ValueError):
        bandit.PolicyConfig(())
    assert len(bandit.default_arms("mic_rms")) == len(bandit.default_arms("temp")) == 12 and len(bandit.default_arms("x")) == 6


def test_replay_against_plain_loop(spark):
    rng = np.random.default_rng(4)
    n, arms = 120, tuple(bandit.default_arms("temp"))
    cfg = bandit.PolicyConfig(arms, mae_max=3.0)
    rows = [("d", "temp", i, i, float(rng.integers(0, 6000)), float(rng.normal(0, 1.5)), float(rng.random()), float(rng.random()),
             int(rng.integers(0, 80)), float(rng.integers(0, 3000)) if rng.random() < 0.8 else None, float(rng.random()),
             float(rng.integers(0, 900))) for i in range(n)]
    df = spark.createDataFrame(rows, "device_id string, sensor string, ts_ns long, seq long, state_aoi double, state_res double,"
                               "state_res_var double, state_loss double, state_q_len long, out_aoi_ms double, out_mae double, out_rate_bps double")
    got = [r.arm for r in bandit.bandit_replay(df, {"temp": cfg}).orderBy("ts_ns").collect()]
    inverse = [np.eye(6) for _ in arms]
    b, counts, want = np.zeros((12, 6)), np.zeros(12), []
    for r in rows:
        x = np.array([1, r[4] / 1000, abs(r[5]), r[6], r[7], r[8] / 50])
        if r[4] >= 5000 or abs(r[5]) >= 3.0:
            arm = 2
        elif (counts < 1).any():
            arm = int(np.argmax(counts < 1))
        else:
            arm = int(np.argmax([x @ inv @ bb + 0.75 * math.sqrt(x @ inv @ x) for inv, bb in zip(inverse, b)]))
        counts[arm] += 1
        want.append(arm)
        if r[9] is not None:
            reward = -(r[9] / 1000 + r[10] + r[11] / 1024)
            # Inverse after one more observation, without a solve.
            ix = inverse[arm] @ x
            inverse[arm] = inverse[arm] - np.outer(ix, ix) / (1 + x @ ix)
            b[arm] += reward * x
    assert got == want and len(set(want)) > 5


def test_theta_of_one_observation_and_of_a_singular_matrix(spark):
    x = np.array([1.0, 0.5, 2.0, 0.0, 0.1, 0.3])
    df = spark.createDataFrame([(0, x.tolist(), -2.0)], "arm int, context array<double>, reward double")
    row = bandit.bandit_theta(bandit.bandit_fit(df, ["arm"], ridge=1.5)).collect()[0]
    inverse = (np.eye(6) - np.outer(x, x) / (1.5 + x @ x)) / 1.5
    assert np.allclose(np.reshape(row.a_inverse, (6, 6)), inverse) and np.allclose(row.theta, inverse @ (-2 * x))
    flat = bandit.bandit_theta(bandit.bandit_fit(df, ["arm"], ridge=0.0)).collect()[0]
    assert flat.theta == [0.0] * 6 and row.tries == 1


def test_ties_go_to_the_first_arm(spark):
    model = spark.createDataFrame([("temp", i, [0.0] * 6, np.eye(6).ravel().tolist()) for i in (1, 0)],
                                  "sensor string, arm int, theta array<double>, a_inverse array<double>")
    states = spark.createDataFrame([("temp", [0.0] * 6)], "sensor string, context array<double>")
    assert bandit.bandit_choose(bandit.bandit_score(states, model)).collect()[0].chosen_arm == 0


# ---- plans


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_are_limited_before_the_shuffle(spark, sf_dir, tmp_path):
    # A stored log: the view itself is already partitioned by stream and would need no shuffle.
    views.arrivals(spark, sf_dir).write.parquet(str(tmp_path / "log"))
    text = plan(dedup_first(spark.read.parquet(str(tmp_path / "log"))))
    assert "WindowGroupLimit" in text and ", Partial" in text


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").where("o_orderkey > 10")
    text = plan(orders.select(F.col("o_orderkey").alias("id"), F.lit(0).alias("status")).transform(backlog.pending_count))
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,10)]" in text
    assert "ReadSchema: struct<o_orderkey:bigint>" in text


BATCH = [n for n in contract.queries() if not n.startswith("stream_") and n not in ("run_report", "event_log_round_trip")]


@pytest.mark.parametrize("name", sorted(BATCH))
def test_no_query_multiplies_rows_by_rows(spark, sf_dir, name):
    text = plan(contract.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # Row-at-a-time Python is never used.
    assert "BatchEvalPython" not in text
