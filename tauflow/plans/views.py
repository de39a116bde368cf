"""The star-schema tables seen as telemetry.

Every view is a DataFrame here and a common table expression in ``oracle.VIEWS``; ``FIXTURES.md``
defines both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tauflow.functions import wire
from tauflow.operators.sequence import SLICE, cut_long_streams, with_previous
from tauflow.schemas import STREAM


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Zone-free timestamps have to mean UTC, whatever the session was started with.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_us(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def samples_of(events: DataFrame) -> DataFrame:
    mic = F.col("event_type").isin("click", "view", "purchase")
    third, ninth = F.col("user_id") % 3, F.col("user_id") % 9
    return events.select(
        F.col("event_id").alias("seq"),
        (epoch_us("ts") * 1000).alias("ts_ns"),
        F.concat(F.lit("dev-"), F.col("user_id")).alias("device_id"),
        F.when(mic, "mic_rms").otherwise("temp").alias("sensor"),
        F.when(mic, -F.col("value") / 4).otherwise(F.col("value") / 4).alias("x"),
        F.when(third == 0, "slow_10kbps").when(third == 1, "delay_loss").otherwise("cellular_var").alias("profile"),
        F.when(ninth < 3, "periodic").when(ninth < 6, "fixed_tau").otherwise("adaptive").alias("policy"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples_of(table(spark, sf_dir, "events"))


def telemetry_of(readings: DataFrame) -> DataFrame:
    """Event log: the forecast is the previous reading, the first reading forecasts itself."""
    previous = with_previous(cut_long_streams(readings, STREAM), STREAM, ("ts_ns", "seq"), {"x": "_x"}).drop(SLICE)
    mic = F.col("sensor") == "mic_rms"
    pred = F.coalesce("_x", "x")
    return previous.select(
        "seq",
        "ts_ns",
        "device_id",
        "sensor",
        F.col("x").alias("val"),
        pred.alias("pred"),
        F.abs(F.col("x") - pred).alias("res"),
        F.when(mic, F.lit(3.0)).otherwise(F.lit(0.2)).alias("tau"),
        F.when(mic, F.lit(6)).otherwise(F.lit(8)).alias("kbits"),
        "profile",
        "policy",
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_of(samples(spark, sf_dir))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as received: every twentieth message comes a second time."""
    received = F.col("ts_ns") + 300_000_000 + (F.col("seq") % 7) * 50_000_000
    copies = F.when(F.col("seq") % 20 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        telemetry(spark, sf_dir)
        .withColumn("copy_no", F.explode(copies))
        .withColumn("t_recv_ns", received + F.col("copy_no") * 2_000_000_000)
    )


def messages_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals as broker messages; some of them are damaged in one of five ways."""
    n = F.col("seq")
    topic = wire.event_topic(F.col("device_id"), F.col("sensor"))
    text = F.col("_text")
    payload = (
        F.when(n % 31 == 0, F.substr(text, F.lit(1), F.length(text) - 1))
        .when(n % 37 == 0, F.regexp_replace(text, '"tau":[^,]*,', ""))
        .when(n % 41 == 0, F.regexp_replace(text, '"val":[^,]*,', '"val":null,'))
        .when(n % 43 == 0, F.regexp_replace(text, '"kbits":[^,]*,', '"kbits":"many",'))
        .otherwise(text)
    )
    return arrivals(spark, sf_dir).withColumn("_text", wire.event_json()).select(
        F.when(n % 47 == 0, F.concat(topic, F.lit("/raw"))).otherwise(topic).alias("topic"),
        payload.alias("payload"),
        F.lit(1).alias("qos"),
        (F.col("copy_no") > 0).alias("dup"),
        F.lit(False).alias("retain"),
        "t_recv_ns",
    )


def temp_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        samples(spark, sf_dir)
        .where("sensor = 'temp'")
        .select("seq", "ts_ns", "device_id", "sensor", F.col("x").alias("celsius"), (F.col("seq") % 11 != 0).alias("valid"))
    )


def raw_temp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature readings as the two-line text of a 1-Wire file and as the one-number text of a plain one."""
    milli = F.floor(F.col("x") * 1000).cast("string")
    crc = F.when(F.col("seq") % 13 == 0, "crc NO").otherwise("crc YES")
    second = F.when(F.col("seq") % 17 == 0, F.lit("junk")).otherwise(F.concat(F.lit("aa t="), milli))
    plain = F.when(F.col("seq") % 19 == 0, "n/a").when(F.col("seq") % 2 == 0, milli).otherwise(
        F.concat(F.floor(F.col("x")).cast("string"), F.lit(".5"))
    )
    return (
        samples(spark, sf_dir)
        .where("sensor = 'temp'")
        .select("seq", F.concat(crc, F.lit("\n"), second).alias("w1_text"), plain.alias("plain_text"))
    )


def pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Widening to double first keeps every engine on the same product.
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda e: F.floor(e.cast("double") * 60000).cast("int")).alias("pcm")
    )


def policy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("seq")
    return telemetry(spark, sf_dir).select(
        "seq",
        "ts_ns",
        "device_id",
        "sensor",
        (n % 7000).cast("double").alias("state_aoi"),
        F.col("res").alias("state_res"),
        (F.col("res") * F.col("res")).alias("state_res_var"),
        ((n % 10) / F.lit(100.0)).alias("state_loss"),
        (n % 60).alias("state_q_len"),
        (n % 12).cast("int").alias("arm"),
        (n % 5000).cast("double").alias("out_aoi_ms"),
        (F.col("res") / 4).alias("out_mae"),
        (n % 900).cast("double").alias("out_rate_bps"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy_log(spark, sf_dir).select(
        "seq",
        "ts_ns",
        "device_id",
        "state_aoi",
        "state_res",
        "state_res_var",
        "state_loss",
        "state_q_len",
        F.lit(0.5).alias("tau"),
        F.lit(8).alias("kbits"),
        F.lit(0.0).alias("reward"),
        (F.col("ts_ns") + 250_000_000).alias("t_recv_ns"),
    )


def queue_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = epoch_us("o_orderdate") * 1000
    status = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        status.alias("status"),
        (F.col("o_orderkey") % 8).cast("int").alias("attempts"),
        due.alias("available_at_ns"),
        (due + 5_000_000_000).alias("last_attempt_ns"),
    )


def clock_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rtc = epoch_us("l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rtc.alias("rtc_us"),
        (rtc + (F.col("l_orderkey") % 9 - 4) * 1_000_000).alias("system_us"),
    )
