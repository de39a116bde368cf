"""Broker messages (topic, payload, qos, dup, retain, t_recv_ns) to typed rows, batch or streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tauflow.functions.measures import arrival_age_ms
from tauflow.operators.packets import with_publish_bytes
from tauflow.operators.validate import PROBLEMS, decision_problems, event_problems, publish_problems
from tauflow.schemas import DECISION, DECISION_KEYS, EVENT, EVENT_KEYS

# The topics of the two message kinds.
EVENT_TOPIC = r"^edge/[^/]+/[^/]+/event$"
DECISION_TOPIC = r"^policy/[^/]+/decision$"


def route(topic: Column) -> Column:
    """``event``, ``decision`` or ``ignored``."""
    return F.when(topic.rlike(EVENT_TOPIC), "event").when(topic.rlike(DECISION_TOPIC), "decision").otherwise("ignored")


def _whole_number(text: Column, spark_type: T.DataType) -> Column:
    """An integer from JSON text; a fraction is cut off as the message reader does."""
    number = text.try_cast("decimal(38,6)")
    return F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).try_cast(spark_type)


def _typed(schema: T.StructType, keys, extra=()) -> list[Column]:
    out = []
    for field in schema:
        key = "ts" if field.name == "ts_ns" else field.name
        if key not in (*keys, *extra):
            continue
        text = F.col(f"_json_{key}")
        if isinstance(field.dataType, T.StringType):
            out.append(text.alias(field.name))
        elif isinstance(field.dataType, T.DoubleType):
            out.append(text.try_cast("double").alias(field.name))
        else:
            out.append(_whole_number(text, field.dataType).alias(field.name))
    return out


def _decode(messages: DataFrame, schema: T.StructType, keys, extra=()) -> DataFrame:
    """Columns of ``schema`` plus the reasons why a payload cannot be read at all.

    Fields are read as text and then cast, so one bad field does not take the others with it.
    """
    wanted = (*keys, *extra)
    as_text = T.StructType([T.StructField(k, T.StringType()) for k in wanted])
    present = F.json_object_keys("payload")
    missing = F.array_except(F.array(*[F.lit(k) for k in keys]), present)
    reasons = F.when(present.isNull(), F.array(F.lit("not a JSON object"))).otherwise(
        F.transform(missing, lambda k: F.concat(k, F.lit(" missing from message")))
    )
    # inline parses a payload once; a plain projection would be copied into every later use of a field.
    parsed = F.array(F.struct(F.from_json("payload", as_text).alias("_json"), reasons.alias("_unreadable")))
    opened = messages.select(*messages.columns, F.inline(parsed))
    flat = opened.select(*messages.columns, "_unreadable", *[F.col(f"_json.{k}").alias(f"_json_{k}") for k in wanted])
    return flat.select(*messages.columns, *_typed(schema, keys, extra), "_unreadable")


def _with_problems(decoded: DataFrame, problems: Column) -> DataFrame:
    # A row that could not be read is not checked field by field as well.
    all_problems = F.when(F.size("_unreadable") > 0, F.col("_unreadable")).otherwise(problems)
    return decoded.withColumn(PROBLEMS, all_problems).drop("_unreadable")


def decode_events(messages: DataFrame) -> DataFrame:
    decoded = _decode(messages, EVENT, EVENT_KEYS, ("aoi_ms",))
    return _with_problems(decoded, event_problems(aoi="aoi_ms"))


def decode_decisions(messages: DataFrame) -> DataFrame:
    return _with_problems(_decode(messages, DECISION, DECISION_KEYS), decision_problems())


def _with_packet_problems(decoded: DataFrame) -> DataFrame:
    """Add what is wrong with the packet to what is wrong with its payload."""
    packet = publish_problems(F.col("topic"), F.octet_length("payload"), F.col("qos"), F.col("dup"))
    return decoded.withColumn(PROBLEMS, F.concat(PROBLEMS, packet))


def event_stream(messages: DataFrame, clock_offset_ns: int = 0) -> DataFrame:
    """Events of their topic with packet size and age on arrival; bad ones carry their reasons."""
    sized = with_publish_bytes(messages.where(F.col("topic").rlike(EVENT_TOPIC)))
    return _with_packet_problems(decode_events(sized)).withColumn(
        "arrival_age_ms", arrival_age_ms(F.col("t_recv_ns"), F.col("ts_ns"), clock_offset_ns)
    )


def decision_stream(messages: DataFrame) -> DataFrame:
    decoded = decode_decisions(messages.where(F.col("topic").rlike(DECISION_TOPIC)))
    return _with_packet_problems(decoded) if {"qos", "dup"} <= set(messages.columns) else decoded
