"""Uniform quantizer with both range ends on the grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tauflow.schemas import KBITS_MAX, KBITS_MIN, SENSOR_RANGES


def sensor_range(sensor: Column, vmin: Column | None = None, vmax: Column | None = None) -> tuple[Column, Column]:
    """Range of each row's sensor; either bound can be overridden, an unknown sensor gives null."""
    low = high = F.lit(None).cast("double")
    for name, (a, b) in SENSOR_RANGES.items():
        low = F.when(sensor == name, F.lit(a)).otherwise(low)
        high = F.when(sensor == name, F.lit(b)).otherwise(high)
    return (low if vmin is None else F.coalesce(vmin, low)), (high if vmax is None else F.coalesce(vmax, high))


def levels(kbits: Column) -> Column:
    """Number of grid points; null outside 1..16 bits."""
    return F.when(kbits.between(KBITS_MIN, KBITS_MAX), F.pow(F.lit(2.0), kbits))


def step(kbits: Column, vmin: Column, vmax: Column) -> Column:
    return F.when(vmax > vmin, (vmax - vmin) / (levels(kbits) - 1))


def quantize(x: Column, kbits: Column, vmin: Column, vmax: Column) -> Column:
    """Struct (q, code, saturated, step): nearest grid point, its number, and whether x hit or passed an end.

    All four are null where x is not finite or the quantizer is not valid.
    """
    width = step(kbits, vmin, vmax)
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    top = levels(kbits) - 1
    code = (
        F.when(x <= vmin, F.lit(0.0))
        .when(x >= vmax, top)
        .otherwise(F.least(F.greatest(F.floor((x - vmin) / width + 0.5).cast("double"), F.lit(0.0)), top))
    )
    code = F.when(finite & width.isNotNull(), code)
    return F.struct(
        (vmin + code * width).alias("q"),
        code.cast("int").alias("code"),
        F.when(code.isNotNull(), (x <= vmin) | (x >= vmax)).alias("saturated"),
        F.when(code.isNotNull(), width).alias("step"),
    )


def quantize_values(xs: Column, kbits: Column, vmin: Column, vmax: Column) -> Column:
    """Array form: struct (values, codes) of the same grid."""
    return F.struct(
        F.transform(xs, lambda x: quantize(x, kbits, vmin, vmax).getField("q")).alias("values"),
        F.transform(xs, lambda x: quantize(x, kbits, vmin, vmax).getField("code")).alias("codes"),
    )


def dequantize(code: Column, kbits: Column, vmin: Column, vmax: Column) -> Column:
    """Value of a grid point; null for a code outside the grid."""
    return F.when((code >= 0) & (code <= levels(kbits) - 1), vmin + code * step(kbits, vmin, vmax))
