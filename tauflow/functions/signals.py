"""Sensor readings: raw text, calibration, audio frames, clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# int16 full scale, and the floor below which a level counts as silence.
FULL_SCALE = 32768.0
SILENCE_RMS = 1e-12
# Fixed value: a plain reading above this is in thousandths of a degree.
MILLI_ABOVE = 200.0
_INT = r"^\s*[+-]?\d+\s*$"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def one_wire_reading(text: Column) -> Column:
    """Struct (celsius, valid) of a two-line 1-Wire reading."""
    lines = F.split(_stripped(F.translate(text, "\r", "")), "\n")
    second = F.get(lines, F.lit(1))
    # Everything behind the first "t=" has to be the number.
    digits = F.when(F.contains(second, F.lit("t=")), F.substr(second, F.locate("t=", second) + 2))
    milli = F.when(digits.rlike(_INT), F.trim(digits).try_cast("bigint"))
    crc_ok = F.endswith(F.get(lines, F.lit(0)), F.lit("YES"))
    return F.struct(
        (milli / F.lit(1000.0)).alias("celsius"),
        F.when(milli.isNotNull(), crc_ok).otherwise(F.lit(False)).alias("valid"),
    )


def plain_reading(text: Column) -> Column:
    """Struct (celsius, valid) of a file that holds one number, in degrees or thousandths."""
    word = _stripped(text)
    v = F.when(word.rlike(_NUMBER), word.try_cast("double"))
    return F.struct(
        F.when(v > MILLI_ABOVE, v / 1000.0).otherwise(v).alias("celsius"), v.isNotNull().alias("valid")
    )


def calibrate(celsius: Column, scale: float = 1.0, offset: float = 0.0) -> Column:
    return F.lit(float(scale)) * celsius + F.lit(float(offset))


def in_range(valid: Column, celsius: Column, min_c: float | None = None, max_c: float | None = None) -> Column:
    """The validity flag, withdrawn for readings outside the given bounds."""
    for bad in [celsius < min_c] * (min_c is not None) + [celsius > max_c] * (max_c is not None):
        valid = F.when(valid & bad, F.lit(False)).otherwise(valid)
    return valid


def frame_level(frame: Column, db_offset: float = 0.0, clip_threshold: float = 0.999) -> Column:
    """Struct (dbfs, clip_ratio) of one frame of int16 samples."""
    n = F.size(frame)
    power = F.aggregate(
        frame, F.lit(0.0), lambda acc, s: acc + (s.cast("double") / FULL_SCALE) * (s.cast("double") / FULL_SCALE)
    )
    # Widen before abs: the lowest int16 has no positive counterpart.
    loud = F.size(F.filter(frame, lambda s: F.abs(s.cast("int")) >= int(clip_threshold * (FULL_SCALE - 1))))
    rms = F.greatest(F.sqrt(power / n), F.lit(SILENCE_RMS))
    return F.struct(
        F.when(n > 0, 20.0 * F.log10(rms) + float(db_offset)).alias("dbfs"),
        F.when(n > 0, loud / n).alias("clip_ratio"),
    )


def clock_drift(system_s: Column, rtc_s: Column, guard_s: float = 2.0, push_system: bool = False) -> Column:
    """Struct (drift_s, synced, action): which of two clocks to step when they differ too much."""
    drift = F.abs(system_s - rtc_s)
    return F.struct(
        drift.alias("drift_s"),
        (drift <= guard_s).alias("synced"),
        F.when(drift <= guard_s, "none")
        .when((system_s < rtc_s) | F.lit(not push_system), "step_system")
        .otherwise("step_rtc")
        .alias("action"),
    )
