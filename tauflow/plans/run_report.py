"""The analysis job: read logs, drop copies, summarize, write tables and texts.

    spark-submit --py-files tauflow.zip tauflow/plans/run_report.py --input LOGS --out FOLDER
"""

from __future__ import annotations

import argparse
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tauflow.operators.summary import scenario_count, summarize
from tauflow.session import staged
from tauflow.sinks.reports import digest_lines, report_lines
from tauflow.sinks.tables import write_lines, write_summary
from tauflow.sources.files import SOURCE_FILE, read_events

# Runs restart their sequence numbers, so an event id is unique only within one run's folder.
RUN = "__run"
RUN_SCOPE = ("profile", "policy", RUN)


def run_report(spark: SparkSession, inputs: Iterable[str], out: str, save_parquet: bool = False) -> DataFrame:
    """Write summary, report and digest below ``out`` and return the summary.

    Every output is made from the few summary rows, which are computed once.
    """
    events = read_events(spark, inputs)
    present = events.dropna(subset=["profile", "policy", "sensor"])
    present = present.withColumn(RUN, F.regexp_extract(SOURCE_FILE, "^(.*)/[^/]*$", 1))
    summary = staged(summarize(present, RUN_SCOPE, order=("ts_ns", SOURCE_FILE)), "summary")
    write_summary(summary, f"{out}/metrics_summary.csv", f"{out}/metrics_summary.parquet" if save_parquet else None)
    write_lines(report_lines(summary), f"{out}/report.md")
    write_lines(digest_lines(summary), f"{out}/digest.txt")
    scenario_count(summary).write.mode("overwrite").json(f"{out}/scenario_count.json")
    return summary


def main() -> None:
    parser = argparse.ArgumentParser(description="Summarize telemetry event logs")
    parser.add_argument("--input", action="append", required=True, help="file or folder, may be repeated")
    parser.add_argument("--out", required=True, help="folder for the results")
    parser.add_argument("--save-parquet", action="store_true", help="write the summary as Parquet as well")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("telemetry-report").getOrCreate()
    run_report(spark, args.input, args.out, args.save_parquet)


if __name__ == "__main__":
    main()
