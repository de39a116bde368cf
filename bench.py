"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up (JVM, generated code, Python workers) and is then timed, the best of
BENCH_RUNS runs; every result row is computed and fetched by Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tauflow.plans.queries import QUERIES  # noqa: E402
from tauflow.session import local_session  # noqa: E402

HEADLINES = (
    "scenario_summary", "aoi_mean", "aoi_percentile", "aoi_percentile_loop", "event_gaps", "dedup_first", "dedup_accounting",
    "event_wire_bytes", "publish_size", "encode_events", "decode_events", "validate_events", "quantize_readings",
    "quantization_report", "send_on_delta", "carry_forward", "reconstruct_hold", "full_series_mae", "ar1_rls_fit", "online_var",
    "frame_rms_dbfs", "backlog_stats", "stuck_messages", "clock_drift", "policy_sweep", "improvement_vs_baseline",
    "pareto_front", "bandit_fit", "bandit_score", "bandit_replay", "stream_dedup",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINES)
    spark = local_session(cpus)
    seconds = {}
    for name in names:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        best = float("inf")
        for _ in range(runs):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - started)
        seconds[name] = round(best, 3)
    print(json.dumps({
        "metric": "total seconds over headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
