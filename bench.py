"""Headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tapewatch.plans.queries import QUERIES  # noqa: E402
from tapewatch.session import get_session  # noqa: E402

HEADLINE = [
    "trade_dedup", "dump_ingest", "bars_ohlcv", "bars_filled", "bar_features", "static_clean", "adaptive_clean",
    "cleaning_stats", "microstructure", "window_stats", "window_labels", "dataset_none", "dataset_adaptive",
    "rule_fit", "threshold_tuning", "ranking_metrics", "event_metrics", "bootstrap_ci", "ks_features",
    "label_alignment", "price_quantiles", "stream_bars",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{root}/events.parquet").count()
    took = {}
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t0, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
