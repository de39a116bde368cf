"""Ages, rates, delays and number text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def arrival_age_ms(t_recv_ns: Column, ts_ns: Column, clock_offset_ns: int = 0) -> Column:
    """Age on arrival in ms; negative if the sender's clock runs ahead."""
    return (t_recv_ns - ts_ns - clock_offset_ns) / F.lit(1e6)


def age_ms(now_s: Column, generated_s: Column) -> Column:
    """Age in ms between two epoch times in seconds, never negative."""
    return F.greatest(F.lit(0.0), (now_s - generated_s) * 1000.0)


def iso_to_epoch(text: Column) -> Column:
    """Epoch seconds of ``YYYY-MM-DDTHH:MM:SS.ffffffZ``; null for any other form."""
    # One to six fraction digits, as the format reads them.
    well_formed = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{1,6}Z$")
    return F.when(well_formed, F.unix_micros(F.try_to_timestamp(text)) / F.lit(1e6))


def bytes_per_second(total_bytes: Column, duration_s: Column) -> Column:
    return F.when(duration_s > 0, total_bytes / duration_s).otherwise(F.lit(NAN))


def percent_improvement(baseline: Column, candidate: Column) -> Column:
    """Reduction against the baseline in percent; NaN without a positive finite baseline."""
    usable = (baseline > 0) & ~F.isnan(baseline) & (baseline < float("inf"))
    return F.when(usable, (baseline - candidate) / baseline * 100.0).otherwise(F.lit(NAN))


def number_text(x: Column, decimals: int) -> Column:
    """Fixed decimals; ``NaN`` for missing and non-finite numbers."""
    x = x.cast("double")
    unusable = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    # Rounds the exact binary value, ties to even; format_string would round the printed decimal.
    return F.when(unusable, "NaN").otherwise(F.translate(F.format_number(x, decimals), ",", ""))


def retry_delay_s(attempts: Column, base_s: float = 1.0, cap_s: float = 60.0) -> Column:
    """Seconds until the next try: doubles with each attempt up to a cap.

    Fixed value: the base is at least 0.05 s; the cap is at least the given base.
    """
    base = max(0.05, base_s)
    doublings = F.greatest(attempts - 1, F.lit(0)).cast("double")
    return F.least(F.lit(float(max(cap_s, base_s))), F.lit(base) * F.pow(F.lit(2.0), doublings))


def skip_nan(x: Column) -> Column:
    """NaN as null, so that aggregates pass over it."""
    return F.nanvl(x, F.lit(None).cast("double"))
