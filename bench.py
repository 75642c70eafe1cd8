"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local cores.
Names given as arguments replace the headline list; ``all`` runs every registered query.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from meterlake.plans.registry import QUERIES  # noqa: E402
from meterlake.session import build_session  # noqa: E402

HEADLINE = [
    "dedupe_max_wins", "daily_usage", "transcript_daily", "cost_estimate", "hour_blocks", "cap_by_tokens", "totals_by",
    "summary_windows", "leaderboard_tokens", "board_rows", "rank_all", "insights_models", "org_analytics", "longest_streak",
    "limit_forecast", "limit_alerts", "window_meter", "rollout_daily", "replay_usage", "tool_stats", "turn_tool_split",
    "task_files", "daily_reports", "reconcile_partial", "apply_correction", "burst_windows", "stream_hourly",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark = build_session("meterlake-bench", f"local[{cpus}]", int(cpus), spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["leaderboard_tokens"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the engine
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
