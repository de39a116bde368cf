"""PCM audio cut into frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frame_samples(rate_hz: int = 16_000, frame_ms: int = 100) -> int:
    return round(rate_hz * frame_ms / 1000)


def frame_audio(recordings: DataFrame, size: int, pcm: str = "pcm", name: str = "frame") -> DataFrame:
    """One row per full frame of ``size`` samples, numbered from 0; an incomplete tail is left out."""
    if size < 1:
        raise ValueError("a frame needs at least one sample")
    full = F.floor(F.size(pcm) / size).cast("int")
    starts = F.when(full > 0, F.sequence(F.lit(0), full - 1)).otherwise(F.array().cast("array<int>"))
    others = [c for c in recordings.columns if c != pcm]
    return recordings.select("*", F.explode(starts).alias("frame_no")).select(
        *others, "frame_no", F.slice(F.col(pcm), F.col("frame_no") * size + 1, size).alias(name)
    )
