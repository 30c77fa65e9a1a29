"""Registered queries against their SQL at the smallest scale.

The slow ones (models, seeds x fractions) are left to tools/check.py.
"""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import TABLES, compare

LIGHT = [
    "trade_scan", "dump_ingest", "dump_ingest_csv", "label_scan", "label_normalise", "envelope_decode", "trade_decode",
    "bar_messages", "event_days", "normal_days", "pair_day_plan", "first_pairs", "trade_dedup", "static_clean",
    "tape_round_trip", "manifest_diff", "threshold_tuning", "ks_features", "full_evaluation", "stream_alerts", "stream_throughput",
    "cleaning_stats_active", "chunk_sigma", "adaptive_clean", "cleaning_stats", "removed_trades", "day_chunks", "bars_ohlcv", "bars_filled", "bars_regrid",
    "minute_closes", "bar_features", "bar_features_blocks", "window_labels", "window_stats", "microstructure",
    "window_tensor", "negatives_sampled", "events_sampled", "labels_merged", "label_alignment", "ranking_metrics",
    "bootstrap_ci", "event_metrics", "price_quantiles", "stream_bars", "stream_dedup", "stream_sessions", "stream_scores",
    "day_file_chunks", "day_file_bars", "dataset_tensor", "dataset_tensor_pool", "file_manifest", "stream_lag", "stream_late_trades",
]


@pytest.fixture(scope="module")
def duck(root):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", LIGHT)
def test_query_matches_sql(spark, root, duck, name):
    got = queries()[name](spark, root).toPandas()
    assert len(got) > 0
    assert compare(got, duck.execute(oracle_sql()[name]).df()) == ""


def test_entry_has_rows(spark):
    df = entry(spark)
    assert df.count() > 0
    assert {"pair", "end_ms", "y", "split", "score"} <= set(df.columns)


def test_every_statement_has_a_query():
    assert set(oracle_sql()) <= set(queries())
