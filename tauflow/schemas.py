"""Row types and fixed values of the telemetry model."""

from __future__ import annotations

from pyspark.sql import types as T

# The enums of the message schema.
SENSORS = ("mic_rms", "temp")
PROFILES = ("slow_10kbps", "delay_loss", "cellular_var")
POLICIES = ("periodic", "fixed_tau", "adaptive")
UNKNOWN = "unknown"

# Required keys, in the order they have on the wire.
EVENT_KEYS = (
    "ts", "seq", "device_id", "sensor", "val", "pred", "res", "tau", "kbits", "profile", "policy",
)
DECISION_KEYS = (
    "ts", "device_id", "state_aoi", "state_res", "state_res_var", "state_loss", "state_q_len",
    "tau", "kbits", "reward",
)

# Recommended quantizer range per sensor (dBFS, degrees C).
SENSOR_RANGES = {"mic_rms": (-80.0, 0.0), "temp": (0.0, 50.0)}
KBITS_MIN, KBITS_MAX = 1, 16

INT64_MAX = 2**63 - 1
UINT64_MAX = 2**64 - 1

# Spark has no unsigned 64-bit type.
SEQ = T.DecimalType(20, 0)

EVENT = T.StructType([
    T.StructField("ts_ns", T.LongType()),
    T.StructField("seq", SEQ),
    T.StructField("device_id", T.StringType()),
    T.StructField("sensor", T.StringType()),
    T.StructField("val", T.DoubleType()),
    T.StructField("pred", T.DoubleType()),
    T.StructField("res", T.DoubleType()),
    T.StructField("tau", T.DoubleType()),
    T.StructField("kbits", T.IntegerType()),
    T.StructField("profile", T.StringType()),
    T.StructField("policy", T.StringType()),
    T.StructField("aoi_ms", T.LongType()),
])

DECISION = T.StructType([
    T.StructField("ts_ns", T.LongType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("state_aoi", T.DoubleType()),
    T.StructField("state_res", T.DoubleType()),
    T.StructField("state_res_var", T.DoubleType()),
    T.StructField("state_loss", T.DoubleType()),
    T.StructField("state_q_len", T.LongType()),
    T.StructField("tau", T.DoubleType()),
    T.StructField("kbits", T.IntegerType()),
    T.StructField("reward", T.DoubleType()),
])

MESSAGE = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("qos", T.IntegerType()),
    T.StructField("dup", T.BooleanType()),
    T.StructField("retain", T.BooleanType()),
    T.StructField("t_recv_ns", T.LongType()),
])

POLICY_STATE = T.StructType([
    T.StructField("ts_ns", T.LongType()),
    T.StructField("aoi_ms", T.DoubleType()),
    T.StructField("res", T.DoubleType()),
    T.StructField("res_var", T.DoubleType()),
    T.StructField("loss", T.DoubleType()),
    T.StructField("q_len", T.LongType()),
])

# A stream is what one sensor of one device produces.
STREAM = ("device_id", "sensor")
SCENARIO = ("profile", "policy", "sensor")
EVENT_ID = ("device_id", "sensor", "seq")
