"""Message rules. A row's broken rules are collected in one array column; a good row has none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tauflow.functions.wire import LENGTH_LIMITS, TOPIC_MAX_BYTES
from tauflow.schemas import (
    DECISION_KEYS,
    EVENT_KEYS,
    INT64_MAX,
    KBITS_MAX,
    KBITS_MIN,
    POLICIES,
    PROFILES,
    SENSORS,
    UINT64_MAX,
)

PROBLEMS = "problems"


def broken(rules: Sequence[tuple[str, Column]]) -> Column:
    """Names of the rules whose condition for a bad row holds."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))


def _not_finite(c: str) -> tuple[str, Column]:
    x = F.col(c)
    return f"{c} not finite", F.isnan(x) | (F.abs(x) == float("inf"))


def _missing(columns: Sequence[str], ts: str) -> list[tuple[str, Column]]:
    return [(f"no {c}", F.col(ts if c == "ts" else c).isNull()) for c in columns]


def _device_rules() -> list[tuple[str, Column]]:
    device = F.col("device_id")
    return [("device_id empty", device == ""), ("device_id with /", F.contains(device, F.lit("/")))]


def _kbits_rule() -> tuple[str, Column]:
    return "kbits out of range", ~F.col("kbits").between(KBITS_MIN, KBITS_MAX)


def _enum_rule(c: str, names: Sequence[str]) -> tuple[str, Column]:
    return f"{c} not one of {', '.join(names)}", ~F.col(c).isin(*names)


def event_problems(ts: str = "ts_ns", aoi: str | None = None) -> Column:
    seq = F.col("seq").cast("decimal(38,0)")
    rules = [
        *_missing(EVENT_KEYS, ts),
        ("ts out of range", ~F.col(ts).between(0, INT64_MAX)),
        ("seq out of range", (seq < 0) | (seq > F.lit(str(UINT64_MAX)).cast("decimal(38,0)"))),
        *_device_rules(),
        _enum_rule("sensor", SENSORS),
        _enum_rule("policy", POLICIES),
        _enum_rule("profile", PROFILES),
        *[_not_finite(c) for c in ("val", "pred", "res", "tau")],
        _kbits_rule(),
    ]
    if aoi:
        rules.append(("aoi_ms negative", F.col(aoi) < 0))
    return broken(rules)


def decision_problems(ts: str = "ts_ns") -> Column:
    loss = F.col("state_loss")
    return broken([
        *_missing(DECISION_KEYS, ts),
        ("ts out of range", ~F.col(ts).between(0, INT64_MAX)),
        *_device_rules(),
        *[_not_finite(c) for c in ("state_aoi", "state_res", "state_res_var", "state_loss", "tau", "reward")],
        ("state_res_var negative", F.col("state_res_var") < 0),
        ("state_loss out of range", ~F.isnan(loss) & ~loss.between(0.0, 1.0)),
        ("state_q_len negative", F.col("state_q_len") < 0),
        _kbits_rule(),
    ])


def topic_problems(topic: Column) -> Column:
    return broken([
        ("topic empty", topic.isNull() | (topic == "")),
        ("topic with wildcard", topic.rlike("[+#]")),
        ("topic too long", F.octet_length(topic) > TOPIC_MAX_BYTES),
    ])


def publish_problems(topic: Column, payload_bytes: Column, qos: Column, dup: Column) -> Column:
    """What keeps a packet from being sent: topic, size, quality of service and its duplicate flag."""
    rest = 2 + F.octet_length(topic) + F.when(qos > 0, 2).otherwise(0) + payload_bytes
    return F.concat(
        topic_problems(topic),
        broken([
            ("payload size negative", payload_bytes < 0),
            ("qos not 0, 1 or 2", ~qos.isin(0, 1, 2)),
            ("dup with qos 0", (qos == 0) & dup),
            ("packet too long", rest > LENGTH_LIMITS[-1]),
        ]),
    )


def validate_events(events: DataFrame, ts: str = "ts_ns", aoi: str | None = None) -> DataFrame:
    return events.withColumn(PROBLEMS, event_problems(ts, aoi))


def validate_decisions(decisions: DataFrame, ts: str = "ts_ns") -> DataFrame:
    return decisions.withColumn(PROBLEMS, decision_problems(ts))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.size(PROBLEMS) == 0).drop(PROBLEMS)


def quarantine(checked: DataFrame) -> DataFrame:
    """The rejected rows with their reasons; good rows go on without them."""
    return checked.where(F.size(PROBLEMS) > 0)
