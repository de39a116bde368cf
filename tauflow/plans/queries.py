"""Every operator as a query over the star-schema tables (or telemetry that Spark derives from them)."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tauflow.functions import measures, quantize, signals, wire
from tauflow.operators import (
    aoi,
    ar1,
    backlog,
    bandit,
    delta,
    experiments,
    packets,
    reconstruct,
    sequence,
    summary,
    validate,
)
from tauflow.operators.dedup import collector_totals, dedup_accounting, dedup_first
from tauflow.operators.trigger import Trigger
from tauflow.plans import views
from tauflow.plans.oracle import model_digits
from tauflow.plans.run_report import run_report
from tauflow.schemas import SCENARIO, STREAM
from tauflow.session import staged, work_folder
from tauflow.sinks import reports, tables
from tauflow.sources import audio, files, messages
from tauflow.streaming import age as streaming_age
from tauflow.streaming import bandit as streaming_bandit
from tauflow.streaming import collect as streaming_collect
from tauflow.streaming import delta as streaming_delta

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ORDER = ("ts_ns", "seq")
SENT_COLUMNS = (*STREAM, *ORDER, "val", "pred", "res", "tau", "kbits", "policy", "reason")
DAY_S = 86_400.0
# "Now" for the queue queries: 1997-01-01, so that some messages are due and some are not.
NOW_NS = 852_076_800_000_000_000
TRIGGERS = (
    Trigger(alpha=0.2, tau=15.0, kbits=6, heartbeat_s=2 * DAY_S, sensor="mic_rms"),
    Trigger(alpha=0.5, tau=12.0, kbits=8, heartbeat_s=DAY_S, min_emit_interval_ms=7_200_000, sensor="temp"),
)
SWEEP = (
    Trigger(alpha=0.2, tau=5.0, kbits=6, heartbeat_s=3 * DAY_S, name="a20_t5"),
    Trigger(alpha=0.2, tau=20.0, kbits=6, heartbeat_s=3 * DAY_S, name="a20_t20"),
    Trigger(alpha=0.5, tau=20.0, kbits=8, heartbeat_s=None, name="a50_t20"),
    Trigger(alpha=0.2, tau=0.0, kbits=8, policy="periodic", name="all"),
)
DEPTHS = {"mic_rms": (4, 6, 8), "temp": (6, 8, 10)}
CONFIGS = {s: bandit.PolicyConfig(arms=tuple(bandit.default_arms(s)), mae_max=10.0) for s in ("mic_rms", "temp")}
FRAME = 20
FILE_ROWS = 500_000


def query(f: Query) -> Query:
    QUERIES[f.__name__.rstrip("_")] = f
    return f


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _r(c: Column, n: int = 6) -> Column:
    return F.round(c, n)


# ---- copies and totals


@query
def dedup_first_(spark, sf_dir):
    first = dedup_first(views.arrivals(spark, sf_dir), order=("ts_ns", "t_recv_ns"))
    return first.select("device_id", "sensor", "seq", "ts_ns", "t_recv_ns", "copy_no", _r(F.col("val")).alias("val"))


def _accounted(spark, sf_dir):
    return dedup_accounting(packets.with_event_bytes(views.arrivals(spark, sf_dir)))


@query
def dedup_accounting_(spark, sf_dir):
    return _accounted(spark, sf_dir).select(
        "device_id", "sensor", "seq", "ts_ns", "t_recv_ns", "first_bytes", "mqtt_size_bytes", "copies_dropped", "dup_flag"
    )


@query
def collector_totals_(spark, sf_dir):
    return collector_totals(_accounted(spark, sf_dir), views.decisions(spark, sf_dir))


# ---- Age of Information


def _gaps(spark, sf_dir):
    stream = [*SCENARIO, "device_id"]
    return aoi.event_gaps(views.telemetry(spark, sf_dir).select(*stream, *ORDER), stream)


def _arrival_gaps(spark, sf_dir):
    stream = [*SCENARIO, "device_id"]
    rows = views.arrivals(spark, sf_dir).select(*stream, *ORDER, "t_recv_ns", "copy_no")
    return aoi.arrival_gaps(rows, stream, ("t_recv_ns", "seq", "copy_no"))


@query
def event_gaps(spark, sf_dir):
    return aoi.event_gaps(views.telemetry(spark, sf_dir), STREAM).select(*STREAM, "seq", "gap_ns")


@query
def event_gaps_cut(spark, sf_dir):
    """The same with streams cut into slices of some rows, as long ones are."""
    return aoi.event_gaps(views.telemetry(spark, sf_dir), STREAM, max_rows=10).select(*STREAM, "seq", "gap_ns")


@query
def aoi_mean(spark, sf_dir):
    return rounded(aoi.aoi_mean(_gaps(spark, sf_dir), SCENARIO), aoi_mean_ms=3)


@query
def aoi_percentile(spark, sf_dir):
    return rounded(aoi.aoi_percentile(_gaps(spark, sf_dir), SCENARIO), aoi_p95_ms=3)


@query
def aoi_percentile_loop(spark, sf_dir):
    return rounded(aoi.aoi_percentile_loop(_gaps(spark, sf_dir), SCENARIO), aoi_p95_loop_ms=3)


@query
def aoi_mean_and_p95(spark, sf_dir):
    # One stream per group: a stream with a single event has no age.
    gaps = aoi.event_gaps(views.telemetry(spark, sf_dir).select(*STREAM, *ORDER), STREAM)
    return rounded(aoi.aoi_mean_and_p95(gaps, STREAM), aoi_mean_ms=3, aoi_p95_ms=3)


@query
def aoi_arrival_order(spark, sf_dir):
    gaps = staged(_arrival_gaps(spark, sf_dir).select(*SCENARIO, "gap_ns"), "gaps")
    both = aoi.aoi_mean(gaps, SCENARIO).join(aoi.aoi_percentile_loop(gaps, SCENARIO), list(SCENARIO))
    return rounded(both, aoi_mean_ms=3, aoi_p95_loop_ms=3)


@query
def online_var(spark, sf_dir):
    return rounded(aoi.online_var(views.samples(spark, sf_dir), STREAM, "x"), mean=11, var=6, std=6)


# ---- messages and bytes


@query
def event_wire_bytes(spark, sf_dir):
    return packets.with_event_bytes(views.telemetry(spark, sf_dir)).select("seq", "mqtt_bytes")


@query
def decision_wire_bytes(spark, sf_dir):
    return packets.with_decision_bytes(views.decisions(spark, sf_dir)).select("seq", "mqtt_bytes")


@query
def publish_size(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    topic = wire.event_topic(F.concat(F.lit("doc-"), F.col("doc_id")), F.col("lang"))
    sized = packets.with_publish_bytes(
        docs.select("doc_id", topic.alias("topic"), F.col("text").alias("payload"), (F.col("doc_id") % 3).cast("int").alias("qos"))
    )
    return sized.select("doc_id", "topic", "qos", "mqtt_bytes")


@F.pandas_udf(T.DoubleType())
def _power(x: pd.Series, y: pd.Series) -> pd.Series:
    """The C library's power, as in the SQL: beyond 53 bits Java's can differ in the last place. Null for null or where there is none."""

    def power(a: float, b: float) -> float:
        try:
            return math.pow(a, b)
        except (OverflowError, ValueError):
            return math.nan

    return pd.Series([power(a, b) for a, b in zip(x, y)], x.index, "float64").where(x.notna() & y.notna())


@query
def remaining_length_bytes(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    # Up to the fourth power of the length, to reach all size classes and the error beyond them; null above 64 bits.
    sizes = docs.select("doc_id", _power(F.col("n_chars").cast("double"), (1 + F.col("doc_id") % 4).cast("double")).alias("size"))
    # The cast alone takes 2^63, which does not fit, as one less.
    sizes = sizes.select("doc_id", F.when(F.col("size") < 2.0**63, F.col("size").try_cast("bigint")).alias("size"))
    return sizes.select("doc_id", "size", wire.remaining_length_bytes(F.col("size")).alias("n"))


@query
def topic_of(spark, sf_dir):
    return views.telemetry(spark, sf_dir).select(
        "seq",
        wire.event_topic(F.col("device_id"), F.col("sensor")).alias("event_topic"),
        wire.decision_topic(F.col("device_id")).alias("decision_topic"),
    )


@query
def encode_events(spark, sf_dir):
    rows = views.telemetry(spark, sf_dir).withColumn("aoi_ms", F.when(F.col("seq") % 3 == 0, F.col("seq") % 1000))
    return rows.select("seq", wire.event_json(aoi="aoi_ms").alias("payload"), wire.event_json_bytes(aoi="aoi_ms").cast("bigint").alias("n_bytes"))


@query
def encode_decisions(spark, sf_dir):
    return views.decisions(spark, sf_dir).select(
        "seq", wire.decision_json().alias("payload"), wire.decision_json_bytes().cast("bigint").alias("n_bytes")
    )


def _event_columns(good: DataFrame) -> DataFrame:
    return good.select(
        F.col("seq").cast("bigint").alias("seq"), "ts_ns", "device_id", "sensor", "val", "pred", "res", "tau", "kbits",
        "profile", "policy", "aoi_ms", "t_recv_ns", "mqtt_bytes", _r(F.col("arrival_age_ms")).alias("arrival_age_ms"),
    )


@query
def decode_events(spark, sf_dir):
    checked = messages.event_stream(views.messages_in(spark, sf_dir), clock_offset_ns=20_000_000)
    return _event_columns(validate.accepted(checked))


@query
def quarantine(spark, sf_dir):
    bad = validate.quarantine(messages.event_stream(views.messages_in(spark, sf_dir)))
    return bad.select("topic", "t_recv_ns", F.array_join("problems", "; ").alias("reasons"))


@query
def quarantine_packets(spark, sf_dir):
    """Messages some of which break a rule of the packet instead of, or besides, one of the payload."""
    kind = F.pmod(F.expr("t_recv_ns div 1000000"), F.lit(7))
    received = views.messages_in(spark, sf_dir).withColumn("qos", F.when(kind == 0, 3).when(kind == 1, 0).otherwise(F.col("qos")))
    bad = validate.quarantine(messages.event_stream(received.withColumn("dup", F.when(kind == 1, True).otherwise(F.col("dup")))))
    return bad.select("topic", "t_recv_ns", F.array_join("problems", "; ").alias("reasons"))


@query
def decode_decisions(spark, sf_dir):
    sent = views.decisions(spark, sf_dir).select(
        wire.decision_topic(F.col("device_id")).alias("topic"), wire.decision_json().alias("payload"), "t_recv_ns"
    )
    good = validate.accepted(messages.decision_stream(sent))
    return rounded(good.drop("topic", "payload"), state_res=9, state_res_var=9)


@query
def route_messages(spark, sf_dir):
    received = views.messages_in(spark, sf_dir)
    return received.groupBy(messages.route(F.col("topic")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# ---- rules


def _nth(c: str, n: int, bad, good) -> Column:
    return F.when(F.col(c) % n == 0, bad).otherwise(good)


@query
def validate_events(spark, sf_dir):
    seq = F.col("seq")
    damaged = views.telemetry(spark, sf_dir).select(
        seq.alias("id"),
        F.when(seq % 71 == 0, F.lit(-1)).otherwise(F.col("ts_ns")).alias("ts_ns"),
        F.when(seq % 79 == 0, F.lit("18446744073709551616")).otherwise(seq.cast("string")).cast("decimal(38,0)").alias("seq"),
        F.when(seq % 31 == 0, "a/b").when(seq % 29 == 0, "").otherwise(F.col("device_id")).alias("device_id"),
        _nth("seq", 37, F.lit("mic"), F.col("sensor")).alias("sensor"),
        _nth("seq", 47, F.lit(float("nan")), F.col("val")).alias("val"),
        "pred",
        _nth("seq", 53, F.lit(float("inf")), F.col("res")).alias("res"),
        F.when(seq % 59 != 0, F.col("tau")).alias("tau"),
        F.when(seq % 61 == 0, 0).when(seq % 67 == 0, 17).otherwise(F.col("kbits")).alias("kbits"),
        _nth("seq", 41, F.lit("lte"), F.col("profile")).alias("profile"),
        _nth("seq", 43, F.lit("linucb#5"), F.col("policy")).alias("policy"),
        _nth("seq", 73, F.lit(-5).cast("bigint"), seq % 1000).alias("aoi_ms"),
    )
    checked = validate.validate_events(damaged, aoi="aoi_ms")
    return checked.select("id", F.array_join("problems", "; ").alias("reasons"))


@query
def validate_decisions(spark, sf_dir):
    seq = F.col("seq")
    damaged = views.decisions(spark, sf_dir).select(
        seq.alias("id"),
        "ts_ns",
        _nth("seq", 31, F.lit("a/b"), F.col("device_id")).alias("device_id"),
        _nth("seq", 37, F.lit(float("-inf")), F.col("state_aoi")).alias("state_aoi"),
        "state_res",
        _nth("seq", 41, F.lit(-0.5), F.col("state_res_var")).alias("state_res_var"),
        F.when(seq % 43 == 0, 1.5).when(seq % 47 == 0, float("nan")).otherwise(F.col("state_loss")).alias("state_loss"),
        _nth("seq", 53, F.lit(-1).cast("bigint"), F.col("state_q_len")).alias("state_q_len"),
        "tau",
        _nth("seq", 59, F.lit(17), F.col("kbits")).alias("kbits"),
        F.when(seq % 61 != 0, F.col("reward")).alias("reward"),
    )
    return validate.validate_decisions(damaged).select("id", F.array_join("problems", "; ").alias("reasons"))


@query
def validate_topic(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    topic = F.when(n % 11 == 0, "").when(n % 7 == 0, F.concat(F.lit("edge/+/"), F.col("lang"))).when(n % 5 == 0, F.col("text"))
    topic = topic.otherwise(F.concat(F.lit("edge/"), F.col("lang")))
    dup = n % 2 == 0
    found = validate.publish_problems(topic, F.col("n_chars"), (n % 4).cast("int"), dup)
    return docs.select("doc_id", F.array_join(found, "; ").alias("reasons"))


# ---- summary and texts


def _summary(spark, sf_dir):
    received = views.arrivals(spark, sf_dir)
    return summary.summarize(received, order=("ts_ns", "t_recv_ns"))


def _rounded_summary(df: DataFrame) -> DataFrame:
    return rounded(
        df, duration_s=6, rate_Bps=9, aoi_mean_ms=3, aoi_p95_ms=3, mae_event_mean=6, mae_event_p95=6, kbits_mean=6
    )


@query
def scenario_summary(spark, sf_dir):
    return _rounded_summary(_summary(spark, sf_dir))


@query
def report_lines(spark, sf_dir):
    return reports.report_lines(_rounded_summary(_summary(spark, sf_dir)))


@query
def digest_lines(spark, sf_dir):
    return reports.digest_lines(_rounded_summary(_summary(spark, sf_dir)))


@query
def top_scenarios(spark, sf_dir):
    return _rounded_summary(summary.top_rows(_summary(spark, sf_dir), 5)).select(*SCENARIO, "n_events", "duration_s")


@query
def scenario_count(spark, sf_dir):
    return summary.scenario_count(views.samples(spark, sf_dir))


@query
def run_report_(spark, sf_dir):
    """Logs on disk, one folder per scenario and without run columns, through the whole analysis job."""
    logs, out = work_folder(spark, "logs"), work_folder(spark, "report")
    rows = views.arrivals(spark, sf_dir).withColumn("_run", F.concat_ws("__", "profile", "policy"))
    # One folder per profile and policy, as a run leaves it behind.
    parts = rows.drop("profile", "policy").withColumnRenamed("ts_ns", "ts").repartition("_run")
    parts.write.partitionBy("_run").parquet(logs)
    _strip_partition_names(spark, logs)
    return _rounded_summary(run_report(spark, [logs], out))


def _strip_partition_names(spark: SparkSession, folder: str) -> None:
    """Rename ``_run=<name>`` folders to ``<name>``: folder names are all that tells the scenario."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("_run="):
            fs.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(path, name[len("_run="):]))


@query
def read_mixed_logs(spark, sf_dir):
    """Logs of several makes in one reading: Parquet with and without run columns, CSV with two orders of columns and one more column."""
    folder = work_folder(spark, "mixed")
    rows = staged(views.telemetry(spark, sf_dir), "telemetry").withColumnRenamed("ts_ns", "ts")
    bare = (F.col("profile") == "slow_10kbps") & (F.col("policy") == "periodic")
    kind = F.col("seq") % 3
    rows.where(bare).drop("profile", "policy").write.parquet(f"{folder}/parquet/slow_10kbps__periodic")
    rows.where(~bare & (kind == 0)).write.parquet(f"{folder}/parquet/whole")
    rows.where(~bare & (kind == 1)).write.option("header", True).csv(f"{folder}/csv/a")
    reversed_columns = rows.withColumn("note", F.lit("x, y")).select("note", *reversed(rows.columns))
    reversed_columns.where(~bare & (kind == 2)).write.option("header", True).csv(f"{folder}/csv/b")
    read = files.read_events(spark, [f"{folder}/parquet", f"{folder}/csv"])
    return read.select("seq", "ts_ns", *STREAM, "val", "pred", "kbits", "profile", "policy")


# ---- quantizer


def _quantized(spark, sf_dir) -> DataFrame:
    vmin, vmax = quantize.sensor_range(F.col("sensor"))
    kbits = (F.col("seq") % 16 + 1).cast("int")
    return (
        views.samples(spark, sf_dir)
        .select("seq", "sensor", "x", kbits.alias("kbits"), vmin.alias("vmin"), vmax.alias("vmax"))
        .withColumn("z", quantize.quantize(F.col("x"), F.col("kbits"), F.col("vmin"), F.col("vmax")))
    )


@query
def quantize_readings(spark, sf_dir):
    z = _quantized(spark, sf_dir)
    return z.select("seq", "kbits", _r(F.col("z.q")).alias("q"), "z.code", "z.saturated", _r(F.col("z.step"), 9).alias("step"))


@query
def dequantize_readings(spark, sf_dir):
    z = _quantized(spark, sf_dir)
    # Every thirteenth code is moved out of the grid.
    code = F.when(F.col("seq") % 13 == 0, F.col("z.code") + 65_536).otherwise(F.col("z.code"))
    back = quantize.dequantize(code, F.col("kbits"), F.col("vmin"), F.col("vmax"))
    return z.select("seq", code.alias("code"), _r(back).alias("value"))


@query
def quantize_array(spark, sf_dir):
    vectors = views.table(spark, sf_dir, "embeddings")
    xs = F.transform("embedding", lambda e: e.cast("double"))
    coded = quantize.quantize_values(xs, F.lit(5), F.lit(-0.25), F.lit(0.25))
    z = vectors.select("vec_id", coded.alias("z"))
    return z.select(
        "vec_id",
        F.array_join(F.col("z.codes").cast("array<string>"), " ").alias("codes"),
        _r(F.aggregate("z.values", F.lit(0.0), lambda a, v: a + v)).alias("value_sum"),
    )


@query
def quantization_report(spark, sf_dir):
    report = experiments.quantization_report(views.samples(spark, sf_dir), DEPTHS)
    return rounded(report, saturated_share=9, mean_abs_error=7, max_abs_error=7)


# ---- readings of one stream


@query
def send_on_delta(spark, sf_dir):
    sent = delta.send_on_delta(views.samples(spark, sf_dir), TRIGGERS)
    return sent.select(*SENT_COLUMNS)


@query
def send_on_delta_cut(spark, sf_dir):
    """The same with streams cut into slices, as long ones are."""
    sent = delta.send_on_delta(views.samples(spark, sf_dir), TRIGGERS, max_rows=10)
    return sent.select(*SENT_COLUMNS)


@query
def carry_forward(spark, sf_dir):
    readings = sequence.cut_long_streams(views.temp_samples(spark, sf_dir), STREAM)
    shown = sequence.carry_forward(readings, STREAM, ORDER, "celsius", "valid", "shown")
    return shown.select("seq", "valid", "shown")


@query
def carry_forward_cut(spark, sf_dir):
    """The same with streams cut into slices of some rows, as long ones are."""
    readings = sequence.cut_long_streams(views.temp_samples(spark, sf_dir), STREAM, max_rows=10)
    return sequence.carry_forward(readings, STREAM, ORDER, "celsius", "valid", "shown").select("seq", "valid", "shown")


@query
def persistence_forecast(spark, sf_dir):
    readings = sequence.cut_long_streams(views.samples(spark, sf_dir), STREAM)
    return sequence.persistence_forecast(readings, STREAM, ORDER, "x").select("seq", "forecast")


@query
def assign_seq(spark, sf_dir):
    readings = sequence.cut_long_streams(views.samples(spark, sf_dir), STREAM)
    numbered = sequence.with_row_index(readings, STREAM, ORDER, "new_seq", start=100)
    return numbered.select("seq", "new_seq")


@query
def ar1_rls_fit(spark, sf_dir):
    readings = sequence.cut_long_streams(views.samples(spark, sf_dir), STREAM)
    return rounded(sequence.ar1_rls_fit(readings, STREAM, ORDER, "x"), a=6)


def _ar1_updates(spark, sf_dir, max_rows: int) -> DataFrame:
    readings = sequence.cut_long_streams(views.samples(spark, sf_dir), STREAM, max_rows=max_rows)
    return rounded(ar1.ar1_rls_update(readings, STREAM, ORDER, "x").select("seq", "a", "forecast"), a=6, forecast=6)


@query
def ar1_rls_update(spark, sf_dir):
    """Coefficient and next forecast after every reading."""
    return _ar1_updates(spark, sf_dir, sequence.MAX_ROWS)


@query
def ar1_rls_update_cut(spark, sf_dir):
    """The same with streams cut into slices of some rows, as long ones are."""
    return _ar1_updates(spark, sf_dir, 10)


@query
def calibrate(spark, sf_dir):
    celsius = signals.calibrate(F.col("celsius"), 1.5, -0.75)
    return views.temp_samples(spark, sf_dir).select(
        "seq", _r(celsius).alias("celsius"), signals.in_range(F.col("valid"), celsius, 1.0, 60.0).alias("valid")
    )


@query
def clock_drift(spark, sf_dir):
    pairs = views.clock_pairs(spark, sf_dir)
    d = signals.clock_drift(F.col("system_us") / 1e6, F.col("rtc_us") / 1e6, push_system=True)
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rtc_us")
    return pairs.select(*keys, d.alias("d")).select(*keys, "d.drift_s", "d.synced", "d.action")


@query
def parse_temp_readings(spark, sf_dir):
    raw = views.raw_temp(spark, sf_dir).select(
        "seq", signals.one_wire_reading(F.col("w1_text")).alias("w"), signals.plain_reading(F.col("plain_text")).alias("p")
    )
    return raw.select("seq", F.col("w.celsius").alias("w1_c"), F.col("w.valid").alias("w1_valid"),
                      F.col("p.celsius").alias("plain_c"), F.col("p.valid").alias("plain_valid"))


@query
def frame_audio(spark, sf_dir):
    frames = audio.frame_audio(views.pcm(spark, sf_dir), FRAME)
    return frames.select("vec_id", "frame_no", F.array_join(F.col("frame").cast("array<string>"), " ").alias("frame"))


@query
def frame_rms_dbfs(spark, sf_dir):
    frames = audio.frame_audio(views.pcm(spark, sf_dir), FRAME)
    level = signals.frame_level(F.col("frame"), db_offset=3.0, clip_threshold=0.25)
    leveled = frames.select("vec_id", "frame_no", level.alias("l"))
    return leveled.select("vec_id", "frame_no", _r(F.col("l.dbfs")).alias("dbfs"), _r(F.col("l.clip_ratio")).alias("clip_ratio"))


# ---- times


@query
def arrival_age(spark, sf_dir):
    age = measures.arrival_age_ms(F.col("t_recv_ns"), F.col("ts_ns"), 400_000_000)
    return views.arrivals(spark, sf_dir).select("seq", "copy_no", _r(age).alias("aoi_ms"))


@query
def age_clamped(spark, sf_dir):
    now, made = F.col("system_us") / F.lit(1e6), F.col("rtc_us") / F.lit(1e6)
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rtc_us")
    return views.clock_pairs(spark, sf_dir).select(*keys, _r(measures.age_ms(now, made)).alias("age_ms"))


@query
def iso_to_epoch(spark, sf_dir):
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.when(F.col("event_id") % 9 == 0, stamp).otherwise(F.concat(stamp, F.lit("Z")))
    events = views.table(spark, sf_dir, "events")
    return events.select("event_id", _r(measures.iso_to_epoch(text)).alias("epoch_s"))


# ---- queue


@query
def backlog_stats(spark, sf_dir):
    return backlog.backlog_stats(views.queue_messages(spark, sf_dir))


@query
def pending_count(spark, sf_dir):
    return backlog.pending_count(views.queue_messages(spark, sf_dir))


@query
def ready_messages(spark, sf_dir):
    return backlog.ready_messages(views.queue_messages(spark, sf_dir), NOW_NS, 25)


@query
def stuck_messages(spark, sf_dir):
    return backlog.stuck_messages(views.queue_messages(spark, sf_dir), NOW_NS)


@query
def retry_delay(spark, sf_dir):
    delay = measures.retry_delay_s(F.col("attempts"), 0.5, 20.0)
    return views.queue_messages(spark, sf_dir).select("id", "attempts", delay.alias("delay_s"))


# ---- comparing policies


@query
def scenario_coverage(spark, sf_dir):
    runs = views.telemetry(spark, sf_dir).withColumn("run", F.floor(F.col("ts_ns") / F.lit(16 * DAY_S * 1e9)))
    return experiments.scenario_coverage(runs, "run")


@query
def improvement_vs_baseline(spark, sf_dir):
    gains = experiments.improvement_vs_baseline(_summary(spark, sf_dir))
    return rounded(gains, rate_gain_pct=6, aoi_gain_pct=6, mae_gain_pct=6)


@query
def pareto_front(spark, sf_dir):
    points = _summary(spark, sf_dir).select(*SCENARIO, "rate_Bps", "aoi_mean_ms")
    return rounded(experiments.pareto_front(points, ["sensor"]), rate_Bps=9, aoi_mean_ms=3)


def _crossings(spark, sf_dir) -> DataFrame:
    """Readings that moved away from the previous one by more than the threshold, and each first reading."""
    rows = views.telemetry(spark, sf_dir)
    return rows.where((F.col("res") > F.when(F.col("sensor") == "temp", 8.0).otherwise(F.col("tau"))) | (F.col("seq") % 50 == 0))


@query
def reconstruct_hold(spark, sf_dir):
    held = reconstruct.reconstruct_hold(views.samples(spark, sf_dir), _crossings(spark, sf_dir))
    return held.select("seq", "x", "restored")


@query
def full_series_mae(spark, sf_dir):
    mae = reconstruct.full_series_mae(views.samples(spark, sf_dir), _crossings(spark, sf_dir), SCENARIO)
    return rounded(mae, mae_full=6, max_error=6)


@query
def policy_sweep(spark, sf_dir):
    swept = experiments.policy_sweep(views.samples(spark, sf_dir), SWEEP)
    return _rounded_summary(swept)


@query
def reconstruct_hold_cut(spark, sf_dir):
    held = reconstruct.reconstruct_hold(views.samples(spark, sf_dir), _crossings(spark, sf_dir), max_rows=10)
    return held.select("seq", "x", "restored")


@query
def policy_sweep_cut(spark, sf_dir):
    return _rounded_summary(experiments.policy_sweep(views.samples(spark, sf_dir), SWEEP, max_rows=10))


# ---- bandit


def _outcomes(spark, sf_dir) -> DataFrame:
    return bandit.with_context_and_reward(views.policy_log(spark, sf_dir), CONFIGS, "context", "reward")


@query
def bandit_context(spark, sf_dir):
    rows = _outcomes(spark, sf_dir)
    return rows.select("seq", *[_r(F.get("context", F.lit(i)), 9).alias(f"x{i}") for i in range(bandit.DIMENSION)])


@query
def bandit_reward(spark, sf_dir):
    return _outcomes(spark, sf_dir).select("seq", _r(F.col("reward"), 11).alias("reward"))


def _model(spark, sf_dir) -> DataFrame:
    return bandit.bandit_fit(_outcomes(spark, sf_dir), ["sensor", "arm"])


@query
def bandit_fit(spark, sf_dir):
    m = _model(spark, sf_dir)
    a = [_r(F.get("a", F.lit(6 * i + j)), model_digits(i, j)).alias(f"a{i}{j}") for i in range(6) for j in range(6)]
    b = [_r(F.get("b", F.lit(i)), 4 if i else 11).alias(f"b{i}") for i in range(6)]
    return m.select("sensor", "arm", "tries", *a, *b)


@query
def bandit_theta(spark, sf_dir):
    solved = bandit.bandit_theta(_model(spark, sf_dir))
    theta = [_r(F.get("theta", F.lit(i)), 6).alias(f"theta{i}") for i in range(6)]
    return solved.select("sensor", "arm", "tries", *theta, *[_r(F.get("a_diag", F.lit(i)), model_digits(i, i)).alias(f"d{i}") for i in range(6)])


def _scored(spark, sf_dir) -> DataFrame:
    states = _outcomes(spark, sf_dir).select("seq", "sensor", "context")
    return bandit.bandit_score(states, bandit.bandit_theta(_model(spark, sf_dir)))


@query
def bandit_score(spark, sf_dir):
    scored = _scored(spark, sf_dir).select("seq", F.explode("scores").alias("s"))
    return scored.select("seq", "s.arm", _r(F.col("s.score")).alias("score"))


@query
def bandit_choose(spark, sf_dir):
    chosen = bandit.bandit_choose(_scored(spark, sf_dir))
    return chosen.select("seq", "sensor", "chosen_arm", _r(F.col("best_score")).alias("best_score"))


@query
def bandit_replay(spark, sf_dir):
    replayed = bandit.bandit_replay(views.policy_log(spark, sf_dir), CONFIGS)
    return replayed.select(*STREAM, *ORDER, "arm", "tau", "kbits", "rule", _r(F.col("reward")).alias("reward"))


# ---- streaming forms; each runs over what is there and returns the resulting table


def _streamed(spark: SparkSession, table: DataFrame, pipeline: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Write a table as several files, run a streaming query over them, read back what it wrote."""
    source, sink = work_folder(spark, "in"), work_folder(spark, "out")
    table.write.parquet(source)
    stream = spark.readStream.schema(table.schema).parquet(source)
    streaming_collect.write_log_stream(pipeline(stream), sink, work_folder(spark, "checkpoint"), None).awaitTermination()
    return spark.read.parquet(sink)


@query
def stream_events(spark, sf_dir):
    def pipeline(received: DataFrame) -> DataFrame:
        return validate.accepted(messages.event_stream(received, clock_offset_ns=20_000_000))

    return _event_columns(_streamed(spark, views.messages_in(spark, sf_dir), pipeline))


@query
def stream_dedup(spark, sf_dir):
    rows = views.arrivals(spark, sf_dir).select("device_id", "sensor", "seq", "ts_ns", "val")
    kept = _streamed(spark, rows, streaming_collect.stream_dedup)
    return kept.select("device_id", "sensor", "seq", "ts_ns", _r(F.col("val")).alias("val"))


@query
def stream_dedup_watermark(spark, sf_dir):
    rows = views.arrivals(spark, sf_dir).select("device_id", "sensor", "seq", "ts_ns", "val")
    kept = _streamed(spark, rows, lambda s: streaming_collect.stream_dedup(s, "40 days"))
    return kept.select("device_id", "sensor", "seq", "ts_ns", _r(F.col("val")).alias("val"))


@query
def stream_dedup_accounting(spark, sf_dir):
    source, sink = work_folder(spark, "in"), work_folder(spark, "out")
    arrivals = views.arrivals(spark, sf_dir)
    arrivals.write.parquet(source)
    stream = spark.readStream.schema(arrivals.schema).parquet(source)
    accounts = streaming_collect.stream_dedup_accounting(packets.with_event_bytes(stream))
    streaming_collect.write_accounting_stream(accounts, sink, work_folder(spark, "checkpoint"), None).awaitTermination()
    return streaming_collect.latest_accounts(spark, sink).select(
        "device_id", "sensor", "seq", "ts_ns", "t_recv_ns", "first_bytes", "mqtt_size_bytes", "copies_dropped", "dup_flag"
    )


def _arriving(spark: SparkSession, arrivals: DataFrame, by: str = "t_recv_ns", batches: int = 6) -> DataFrame:
    """A table as a stream that comes in so many micro-batches, in order of arrival."""
    source = work_folder(spark, "in")
    arrivals = staged(arrivals, "arrivals")
    borders = [-1, *sorted(set(arrivals.approxQuantile(by, [i / batches for i in range(1, batches)], 0.01))), float("inf")]
    inside = [(F.col(by) > low) & (F.col(by) <= high) for low, high in zip(borders, borders[1:])]
    sizes = arrivals.agg(*[F.count(F.when(c, 1)) for c in inside]).first()
    # Equally many files for each micro-batch; none of them is empty, as each has far more rows than files.
    n_files = max(1, min(sizes) // FILE_ROWS)
    for rows in inside:
        arrivals.where(rows).repartition(n_files).write.mode("append").parquet(source)
    return spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", n_files).parquet(source)


@query
def stream_dedup_accounting_watermark(spark, sf_dir):
    """Final accounts from six micro-batches: all those of events older than a day before the newest one."""
    sink = work_folder(spark, "out")
    stream = _arriving(spark, packets.with_event_bytes(views.arrivals(spark, sf_dir)))
    accounts = streaming_collect.stream_final_accounts(stream, "1 day")
    streaming_collect.write_log_stream(accounts, sink, work_folder(spark, "checkpoint"), None).awaitTermination()
    return spark.read.parquet(sink).select(
        "device_id", "sensor", "seq", "ts_ns", "t_recv_ns", "first_bytes", "mqtt_size_bytes", "copies_dropped", "dup_flag"
    )


@query
def stream_aoi(spark, sf_dir):
    """Running mean and percentile of each stream's age over six micro-batches in order of arrival, times going back among them."""
    sink = work_folder(spark, "out")
    keys, order = [*SCENARIO, "device_id"], ["t_recv_ns", "seq", "copy_no"]
    stream = _arriving(spark, views.arrivals(spark, sf_dir).select(*keys, *order, "ts_ns"))
    ages = streaming_age.stream_age(stream, keys, order)
    streaming_collect.write_accounting_stream(ages, sink, work_folder(spark, "checkpoint"), None).awaitTermination()
    latest = streaming_collect.latest_accounts(spark, sink, keys)
    return rounded(latest.select(*keys, "n_gaps", "last_ts_ns", "aoi_mean_ms", "aoi_p95_ms"), aoi_mean_ms=3, aoi_p95_ms=3)


@query
def stream_send_on_delta(spark, sf_dir):
    sent = _streamed(spark, views.samples(spark, sf_dir), lambda s: streaming_delta.stream_send_on_delta(s, TRIGGERS))
    return sent.select(*SENT_COLUMNS)


@query
def stream_bandit(spark, sf_dir):
    replayed = _streamed(spark, views.policy_log(spark, sf_dir), lambda s: streaming_bandit.stream_bandit(s, CONFIGS))
    return replayed.select(*STREAM, *ORDER, "arm", "tau", "kbits", "rule", _r(F.col("reward")).alias("reward"))


@query
def event_log_round_trip(spark, sf_dir):
    """Collected events written as the partitioned log and read back, one row per scenario."""
    path = work_folder(spark, "event-log")
    accounted = _accounted(spark, sf_dir).withColumn("topic", wire.event_topic(F.col("device_id"), F.col("sensor")))
    tables.write_event_log(accounted, path)
    tables.write_event_log(accounted, path)  # replaces the first as a whole
    return tables.read_log(spark, path).groupBy(*SCENARIO).agg(
        F.count(F.lit(1)).alias("n"), F.sum("mqtt_size_bytes").alias("bytes"), F.max("t_recv_ns").alias("last_recv_ns")
    )


def _decision_messages(spark, sf_dir):
    return views.decisions(spark, sf_dir).select(
        wire.decision_topic(F.col("device_id")).alias("topic"), wire.decision_json().alias("payload"), "t_recv_ns"
    )


@query
def stream_decisions(spark, sf_dir):
    """Decisions from a running collection."""
    def pipeline(received: DataFrame) -> DataFrame:
        return validate.accepted(messages.decision_stream(received)).drop("topic", "payload")

    return rounded(_streamed(spark, _decision_messages(spark, sf_dir), pipeline), state_res=9, state_res_var=9)


@query
def decision_log_round_trip(spark, sf_dir):
    """Decisions written as the decision log and read back."""
    path = work_folder(spark, "decision-log")
    good = validate.accepted(messages.decision_stream(_decision_messages(spark, sf_dir)))
    tables.write_decision_log(good.drop("topic", "payload"), path)
    return rounded(spark.read.parquet(path), state_res=9, state_res_var=9)


@query
def collector_meta(spark, sf_dir):
    """The collection run's record, written and read back."""
    path = work_folder(spark, "collector-meta")
    totals = collector_totals(_accounted(spark, sf_dir), views.decisions(spark, sf_dir))
    tables.write_collector_meta(totals, path, "run-1", 20_000_000)
    return spark.read.schema(f"run_id string, clock_offset_ns bigint, {', '.join(f'{c} bigint' for c in totals.columns)}").json(path)


@query
def summary_file(spark, sf_dir):
    """The summary's CSV file read back, with the number of each line in the file."""
    path = work_folder(spark, "summary")
    made = _rounded_summary(_summary(spark, sf_dir))
    tables.write_summary(made, path)
    lines = spark.read.schema(made.schema).option("header", True).csv(path)
    return lines.select((F.monotonically_increasing_id() + 1).alias("line_no"), "*")


@query
def log_rows_in_order(spark, sf_dir):
    """Position of every event in log order within its device and sensor."""
    events = sequence.cut_long_streams(views.telemetry(spark, sf_dir), STREAM)
    return sequence.with_row_index(events, STREAM, ORDER, "position", start=1).select(*STREAM, "seq", "position")


@query
def log_rows_in_order_cut(spark, sf_dir):
    events = sequence.cut_long_streams(views.telemetry(spark, sf_dir), STREAM, max_rows=10)
    return sequence.with_row_index(events, STREAM, ORDER, "position", start=1).select(*STREAM, "seq", "position")
