"""Summary tables as text: a Markdown report and a short digest. Both are DataFrames (line_no, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tauflow.functions.measures import number_text
from tauflow.operators.summary import summary_order

# Decimals per measure.
DECIMALS = {
    "duration_s": 1, "rate_Bps": 1, "aoi_mean_ms": 1, "aoi_p95_ms": 1,
    "mae_event_mean": 3, "mae_event_p95": 3, "kbits_mean": 2,
}
DIGEST_ROWS = 10
REPORT_HEAD = (
    "# Scenario summary",
    "",
    "Error figures are residuals at sent events, not the error of the restored series.",
    "",
    "| profile | policy | sensor | events | duration s | rate B/s | AoI mean ms | AoI p95 ms | MAE mean | MAE p95 | bits |",
    "|---|---|---|---:|---:|---:|---:|---:|---:|---:|---:|",
)
TITLE = "**Telemetry summary**"
NOTHING = "No rows to report."


def _numbered(summary: DataFrame) -> DataFrame:
    # A summary has one row per scenario, few enough for a single window.
    return summary.withColumn("_n", F.row_number().over(Window.orderBy(*summary_order())).cast("bigint"))


def _measure(c: str) -> Column:
    return number_text(F.col(c), DECIMALS[c])


def report_lines(summary: DataFrame) -> DataFrame:
    """Markdown table of all scenarios in report order."""
    cells = [F.col("profile"), F.col("policy"), F.col("sensor"), F.col("n_events").cast("string")]
    cells += [_measure(c) for c in DECIMALS]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = _numbered(summary).select((F.col("_n") + (len(REPORT_HEAD) - 1)).alias("line_no"), row.alias("line"))
    head = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("line_no"), F.lit(t).alias("line"))
                               for i, t in enumerate(REPORT_HEAD)]))
    fixed = summary.sparkSession.range(1).select(head.alias("h")).select("h.line_no", "h.line")
    return fixed.unionByName(body)


def digest_lines(summary: DataFrame, limit: int = DIGEST_ROWS) -> DataFrame:
    """Title, how many of how many rows follow, the first ``limit`` rows, and a note if that is not all."""
    shown = _numbered(summary).where(F.col("_n") <= limit)
    text = F.concat(
        F.col("_n").cast("string"), F.lit(". "), F.col("sensor"), F.lit(", "), F.col("policy"), F.lit(" on "), F.col("profile"),
        F.lit(": MAE="), _measure("mae_event_mean"), F.lit(" [P95 "), _measure("mae_event_p95"),
        F.lit("], rate="), _measure("rate_Bps"), F.lit(" B/s, age "), _measure("aoi_mean_ms"), F.lit(" ms [P95 "), _measure("aoi_p95_ms"),
        F.lit(" ms], "), _measure("kbits_mean"), F.lit(" bits, "), F.col("n_events").cast("string"), F.lit(" messages"),
    )
    body = shown.select((F.col("_n") + 1).alias("line_no"), text.alias("line"))
    counted = summary.agg(F.count(F.lit(1)).alias("_rows"))
    rows, top = F.col("_rows"), F.least(F.col("_rows"), F.lit(limit))

    def line(number: Column, text: Column) -> Column:
        return F.struct(number.cast("bigint").alias("line_no"), text.alias("line"))

    frame = F.array(
        line(F.lit(0), F.lit(TITLE)),
        F.when(rows == 0, line(F.lit(1), F.lit(NOTHING))).otherwise(
            line(F.lit(1), F.concat(F.lit("Top "), top.cast("string"), F.lit(" of "), rows.cast("string"), F.lit(" rows.")))
        ),
        F.when(rows > limit, line(F.lit(limit + 2), F.concat(F.lit("Left out: "), (rows - limit).cast("string")))),
    )
    fixed = counted.select(F.explode(F.array_compact(frame)).alias("h")).select("h.line_no", "h.line")
    return fixed.unionByName(body)
