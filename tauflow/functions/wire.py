"""Message text, topics and packet sizes on the wire, as native column arithmetic."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from tauflow.schemas import DECISION_KEYS, EVENT_KEYS

# The largest remaining length that 1, 2, 3 and 4 length bytes can express.
LENGTH_LIMITS = (127, 16_383, 2_097_151, 268_435_455)
# Fixed value: longest topic, in UTF-8 bytes.
TOPIC_MAX_BYTES = 65_535

# Characters that JSON escapes to two characters; other control characters take six (\u00XX).
_SHORT_ESCAPES = '"\\\b\f\n\r\t'
_LONG_ESCAPES = "".join(chr(i) for i in range(32) if chr(i) not in _SHORT_ESCAPES)
_ANY_ESCAPE = r'["\\\x00-\x1f]'


def remaining_length_bytes(x: Column) -> Column:
    """How many length bytes the packet header needs; null above the limit of the format."""
    size = F.when(x < 0, F.lit(None).cast("int"))
    for n, limit in enumerate(LENGTH_LIMITS, start=1):
        size = size.when(x <= limit, F.lit(n))
    return size


def packet_rest(topic: Column, payload_bytes: Column, qos: Column) -> Column:
    """What follows the length bytes: topic with its length, packet id above qos 0, payload."""
    return 2 + F.octet_length(topic) + F.when(qos > 0, 2).otherwise(0) + payload_bytes


def packet_size(rest: Column) -> Column:
    return (1 + remaining_length_bytes(rest) + rest).cast("bigint")


def publish_size(topic: Column, payload_bytes: Column, qos: Column) -> Column:
    """Bytes of one publish packet; null if it is too long for the format."""
    return packet_size(packet_rest(topic, payload_bytes, qos))


def event_topic(device_id: Column, sensor: Column) -> Column:
    return F.concat(F.lit("edge/"), device_id, F.lit("/"), sensor, F.lit("/event"))


def decision_topic(device_id: Column) -> Column:
    return F.concat(F.lit("policy/"), device_id, F.lit("/decision"))


def _scaled_parts(text: Column) -> tuple[Column, Column, Column]:
    """Digits, how many, and the exponent of a number printed as ``d.dddE[-]xx``."""
    mantissa = F.substring_index(F.ltrim(text, F.lit("-")), "E", 1)
    whole = F.endswith(mantissa, F.lit(".0"))
    digits = F.translate(F.when(whole, F.substring_index(mantissa, ".", 1)).otherwise(mantissa), ".", "")
    n = F.when(whole, 1).otherwise(F.length(mantissa) - 1)
    return digits, n, F.substring_index(text, "E", -1).try_cast("int")


def float_text(x: Column) -> Column:
    """A finite double as the message encoder writes it: plain from 1e-4 up to 1e16, else exponent form.

    Spark also prints the shortest digits that read back, but takes to exponent form below 1e-3 and
    from 1e7, so only such numbers are rewritten. From 1e16 some Java versions print a digit too many.
    """
    text = x.cast("string")
    digits, n, e = _scaled_parts(text)
    plain = F.concat(
        F.rpad(F.substr(digits, F.lit(1), e + 1), e + 1, F.lit("0")),
        F.lit("."),
        F.when(n > e + 1, F.substr(digits, e + 2)).otherwise("0"),
    )
    scaled = F.concat(
        F.substr(digits, F.lit(1), F.lit(1)),
        F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""),
        F.when(e < 0, "e-").otherwise("e+"),
        F.lpad(F.abs(e).cast("string"), F.greatest(F.length(F.abs(e).cast("string")), F.lit(2)), F.lit("0")),
    )
    body = (
        F.when(e == -4, F.concat(F.lit("0.000"), digits)).when((e > 0) & (e < 16), plain).otherwise(scaled)
    )
    return F.when(_is_scaled(text), F.concat(F.when(x < 0, "-").otherwise(""), body)).otherwise(text)


def float_length(x: Column) -> Column:
    """Length of ``float_text`` without building it."""
    return _number_length(x.cast("string"))


def _number_length(text: Column) -> Column:
    _, n, e = _scaled_parts(text)
    body = (
        F.when(e == -4, n + 5)
        .when((e > 0) & (e < 16), e + 2 + F.greatest(n - e - 1, F.lit(1)))
        .otherwise(n + F.when(n > 1, 3).otherwise(2) + F.when(F.abs(e) >= 100, 3).otherwise(2))
    )
    scaled = body + F.when(F.startswith(text, F.lit("-")), 1).otherwise(0)
    return F.when(_is_scaled(text), scaled).otherwise(F.length(text))


def _is_scaled(text: Column) -> Column:
    return F.contains(text, F.lit("E"))


def _text_length(s: Column) -> Column:
    """UTF-8 length of a string inside JSON quotes, escapes included; these are counted only where there are any."""
    short = F.length(s) - F.length(F.translate(s, _SHORT_ESCAPES, ""))
    long = F.length(s) - F.length(F.translate(s, _LONG_ESCAPES, ""))
    return F.octet_length(s) + F.when(s.rlike(_ANY_ESCAPE), short + 5 * long).otherwise(0)


def _json_string(s: Column) -> Column:
    quoted = F.to_json(F.struct(s.alias("s")))
    return F.substr(quoted, F.lit(6), F.length(quoted) - 6)


_EVENT_KINDS = {
    "ts": "int", "seq": "int", "device_id": "text", "sensor": "text", "val": "float", "pred": "float",
    "res": "float", "tau": "float", "kbits": "int", "profile": "text", "policy": "text", "aoi_ms": "int",
}
_DECISION_KINDS = {
    "ts": "int", "device_id": "text", "state_aoi": "float", "state_res": "float", "state_res_var": "float",
    "state_loss": "float", "state_q_len": "int", "tau": "float", "kbits": "int", "reward": "float",
}


def _json(keys, kinds, fields: dict[str, Column]) -> Column:
    """The text up to the closing brace. Neighbouring numbers share one expression, see ``_json_length``."""
    parts, heads = [], [("{" if i == 0 else ",") + f'"{key}":' for i, key in enumerate(keys)]
    for kind, run in groupby(zip(keys, heads), key=lambda kh: kinds[kh[0]]):
        run = list(run)
        if kind == "float":
            texts = F.array(*[fields[k].cast("double") for k, _ in run])
            labels = F.array(*[F.lit(h) for _, h in run])
            parts.append(F.array_join(F.zip_with(labels, texts, lambda h, x: F.concat(h, float_text(x))), ""))
        else:
            for k, h in run:
                parts += [F.lit(h), _json_string(fields[k]) if kind == "text" else fields[k].cast("string")]
    return F.concat(*parts)


def _json_length(keys, kinds, fields: dict[str, Column]) -> Column:
    by_kind = {kind: [fields[k] for k in keys if kinds[k] == kind] for kind in ("int", "float", "text")}
    fixed = sum(len(f',"{key}":') for key in keys) + 1 + 2 * len(by_kind["text"])
    floats = F.array(*[c.cast("double").cast("string") for c in by_kind["float"]])
    # One expression for all numbers: spelled out per column it outgrows what the JVM compiles.
    total = F.aggregate(floats, F.lit(fixed), lambda acc, text: acc + _number_length(text))
    total = total + F.length(F.concat(*[c.cast("string") for c in by_kind["int"]]))
    return total + _text_length(F.concat(*by_kind["text"]))


def _event_fields(ts: str, aoi: str | None) -> dict[str, Column]:
    fields = {key: F.col(ts if key == "ts" else key) for key in EVENT_KEYS}
    if aoi:
        fields["aoi_ms"] = F.col(aoi)
    return fields


def event_json(ts: str = "ts_ns", aoi: str | None = None) -> Column:
    """The compact event message; a null age is left out."""
    fields = _event_fields(ts, aoi)
    head = _json(EVENT_KEYS, _EVENT_KINDS, fields)
    tail = F.coalesce(F.concat(F.lit(',"aoi_ms":'), fields["aoi_ms"].cast("string")), F.lit("")) if aoi else F.lit("")
    return F.concat(head, tail, F.lit("}"))


def event_json_bytes(ts: str = "ts_ns", aoi: str | None = None) -> Column:
    """UTF-8 length of ``event_json`` without building the text."""
    fields = _event_fields(ts, aoi)
    size = _json_length(EVENT_KEYS, _EVENT_KINDS, fields)
    if aoi:
        size = size + F.coalesce(len(',"aoi_ms":') + F.length(fields["aoi_ms"].cast("string")), F.lit(0))
    return size


def _decision_fields(ts: str) -> dict[str, Column]:
    return {key: F.col(ts if key == "ts" else key) for key in DECISION_KEYS}


def decision_json(ts: str = "ts_ns") -> Column:
    return F.concat(_json(DECISION_KEYS, _DECISION_KINDS, _decision_fields(ts)), F.lit("}"))


def decision_json_bytes(ts: str = "ts_ns") -> Column:
    return _json_length(DECISION_KEYS, _DECISION_KINDS, _decision_fields(ts))
