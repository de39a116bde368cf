"""Packet sizes as columns.

Each size is built in two steps, payload first: the packet header depends on the payload in several
places, and a column of its own keeps Spark from working the payload length out for each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tauflow.functions import wire


def with_event_bytes(events: DataFrame, name: str = "mqtt_bytes", ts: str = "ts_ns", qos: int = 1) -> DataFrame:
    """Add the bytes of the packet that carries each event; where a row has a recorded size of that name, it is kept."""
    if name in events.columns:
        computed = with_event_bytes(events.withColumnRenamed(name, "_recorded"), name, ts, qos)
        return computed.withColumn(name, F.coalesce(F.col("_recorded").cast("bigint"), name)).select(*events.columns)
    topic = wire.event_topic(F.col("device_id"), F.col("sensor"))
    rest = wire.packet_rest(topic, F.col("_payload"), F.lit(qos))
    return _with_size(events.withColumn("_payload", wire.event_json_bytes(ts)), rest, name)


def with_decision_bytes(decisions: DataFrame, name: str = "mqtt_bytes", ts: str = "ts_ns", qos: int = 1) -> DataFrame:
    rest = wire.packet_rest(wire.decision_topic(F.col("device_id")), F.col("_payload"), F.lit(qos))
    return _with_size(decisions.withColumn("_payload", wire.decision_json_bytes(ts)), rest, name)


def with_publish_bytes(messages: DataFrame, name: str = "mqtt_bytes") -> DataFrame:
    """Add the packet size of received messages (topic, payload, qos)."""
    rest = wire.packet_rest(F.col("topic"), F.octet_length("payload"), F.col("qos"))
    return _with_size(messages.withColumn("_payload", F.lit(0)), rest, name)


def _with_size(df: DataFrame, rest, name: str) -> DataFrame:
    return df.withColumn("_rest", rest).withColumn(name, wire.packet_size(F.col("_rest"))).drop("_payload", "_rest")
