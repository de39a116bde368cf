"""Log and summary tables, each replaced as a whole.

A table is written beside its place, under a hidden name, and put there by renaming when it is complete; only then does the
old one go. A write that fails or is killed leaves the old table as it was. Killed in the moment between the two
renames, it leaves the old table under its hidden name; the next ``read_log`` or write puts it back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tauflow.operators.summary import summary_order

# The columns of a collected event log.
EVENT_LOG = (
    "device_id", "sensor", "profile", "policy", "seq", "ts_ns", "t_recv_ns", "val", "pred", "res", "tau", "kbits",
    "topic", "mqtt_size_bytes", "dup_flag",
)
PARTITIONS = ("profile", "policy")
# Types of the log that are narrower than those of the columns.
WRITERS = 64
NARROW = {"tau": "float", "kbits": "smallint", "mqtt_size_bytes": "int"}


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _beside(spark: SparkSession, place, mark: str):
    return spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}.{mark}")


def restore(spark: SparkSession, path: str) -> None:
    """Put the old table back where a replacement was killed between its two renames."""
    fs, place = _place(spark, path)
    if fs.exists(place) or place.getParent() is None or not fs.exists(place.getParent()):
        return
    old = fs.globStatus(_beside(spark, place, "old-*")) or []
    if old:
        fs.rename(max(old, key=lambda s: s.getModificationTime()).getPath(), place)


def replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Call ``write`` with a hidden path beside ``path``, then switch; what was at ``path`` goes last."""
    restore(spark, path)
    fs, place = _place(spark, path)
    name = uuid.uuid4().hex
    new, old = _beside(spark, place, f"new-{name}"), _beside(spark, place, f"old-{name}")
    try:
        write(new.toString())
    except BaseException:
        fs.delete(new, True)
        raise
    had_old = fs.exists(place)
    if had_old and not fs.rename(place, old):
        raise OSError(f"{path} cannot be moved aside")
    if not fs.rename(new, place):
        if had_old:
            fs.rename(old, place)
        raise OSError(f"{new} cannot be moved to {path}")
    if had_old:
        fs.delete(old, True)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet log written here."""
    restore(spark, path)
    return spark.read.parquet(path)


def write_event_log(events: DataFrame, path: str, partition_by: tuple[str, ...] = PARTITIONS) -> None:
    """Parquet, one directory per profile and policy, so that scenario queries skip the others' files.

    Rows are dealt out by directory and a hash of the device first, so a task writes to few directories.
    """
    columns = [F.col(c).cast(NARROW[c]).alias(c) if c in NARROW else F.col(c) for c in EVENT_LOG if c in events.columns]
    dealt = F.pmod(F.xxhash64("device_id"), F.lit(WRITERS))
    rows = events.repartition(*partition_by, dealt).select(*columns)
    replace(events.sparkSession, path, lambda new: rows.write.partitionBy(*partition_by).parquet(new))


def write_decision_log(decisions: DataFrame, path: str) -> None:
    replace(decisions.sparkSession, path, lambda new: decisions.write.parquet(new))


def write_collector_meta(totals: DataFrame, path: str, run_id: str, clock_offset_ns: int = 0) -> None:
    """One JSON record with the totals of a collection run."""
    record = totals.select(F.lit(run_id).alias("run_id"), F.lit(clock_offset_ns).alias("clock_offset_ns"), "*")
    replace(totals.sparkSession, path, lambda new: record.write.json(new))


def write_summary(summary: DataFrame, path: str, parquet_path: str | None = None) -> None:
    """One CSV file in report order (a summary has one row per scenario), on request Parquet as well."""
    ordered = summary.repartition(1).sortWithinPartitions(*summary_order())
    replace(summary.sparkSession, path, lambda new: ordered.write.option("header", True).csv(new))
    if parquet_path:
        replace(summary.sparkSession, parquet_path, lambda new: ordered.write.parquet(new))


def write_lines(lines: DataFrame, path: str) -> None:
    """Numbered text lines as one text file."""
    ordered = lines.repartition(1).sortWithinPartitions("line_no").select("line")
    replace(lines.sparkSession, path, lambda new: ordered.write.text(new))
