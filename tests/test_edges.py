"""Hand-made frames for the edges of each rule."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewatch.config import DAY, DEFAULT, HOUR, MINUTE
from tapewatch.functions.ranking import exact_quantiles, running_totals, smallest_keys
from tapewatch.operators import bars as B, clean as K, evaluate as E, events as V, scoring as S, windows as N
from tapewatch.sources import datasets as D, trades as T

TRADE = "pair string, agg_id bigint, price double, qty double, time bigint, is_buyer_maker boolean"


def tape(spark, prices, step=1000, start=0, pair="A"):
    return spark.createDataFrame([(pair, i, float(p), 1.0, start + i * step, False) for i, p in enumerate(prices)], TRADE)


def test_spike_rules(spark):
    prices = [100.0] * 5 + [110.0] + [100.0] * 5 + [120.0]
    out = K.flag_trades(tape(spark, prices), "static", DEFAULT).filter("removed").toPandas()
    # the reverting spike and the move back go by the same test; the last trade has no next
    r = np.diff(np.log(prices), prepend=math.log(100))
    nxt = np.append(r[1:], 0.0)
    want = np.where((np.abs(r) > 0.02) & (np.abs(r + nxt) < 0.3 * np.abs(r)))[0]
    assert sorted(out["agg_id"]) == list(want)
    assert 5 in set(out["agg_id"]) and 11 not in set(out["agg_id"])


def test_short_chunks_are_left_alone(spark):
    nine = [100, 150, 100, 100, 100, 100, 100, 100, 100]
    assert K.flag_trades(tape(spark, nine), "static", DEFAULT).filter("removed").count() == 0
    forty = [100, 150, 100] + [100] * 37
    assert K.flag_trades(tape(spark, forty), "adaptive", DEFAULT).filter("removed").count() == 0


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        K.flag_trades(tape(spark, [1, 2]), "other")


def test_chunks_break_on_two_days_only(spark):
    days = spark.createDataFrame([("A", d, 1) for d in (0, 1, 3, 4, 7)], "pair string, day int, n bigint")
    got = [r["chunk_id"] for r in K.chunk_map(days).orderBy("day").collect()]
    assert got == [0, 0, 1, 1, 2]


def test_bars_ties_gaps_and_zero_volume(spark):
    rows = [
        ("A", 2, 11.0, 0.0, 1000, False), ("A", 1, 10.0, 0.0, 1000, True),  # same ms: id decides
        ("A", 3, 12.0, 2.0, 16000, False),
    ]
    t = spark.createDataFrame(rows, TRADE)
    b = B.trades_to_bars(t, DEFAULT).withColumn("chunk_id", F.lit(0))
    g = B.fill_bar_gaps(b, DEFAULT).orderBy("bar_ms").toPandas()
    assert list(g["bar_ms"]) == [0, 5000, 10000, 15000]
    assert (g["open"][0], g["close"][0], g["vwap"][0]) == (10.0, 11.0, 11.0)
    assert list(g["n_trades"]) == [2, 0, 0, 1]
    assert list(g["high"][1:3]) == [11.0, 11.0]


def test_ids_too_large_stop_the_job(spark):
    t = spark.createDataFrame([("A", 2**60, 1.0, 1.0, 0, False), ("A", 2**60 + 1, 2.0, 1.0, 0, False)], TRADE)
    with pytest.raises(Exception, match="agg_id needs more"):
        B.trades_to_bars(t, DEFAULT).collect()
    r = B.trades_to_bars(t, DEFAULT, wide_ids=True).first()
    assert (r["open"], r["close"]) == (1.0, 2.0)


def test_labels_are_closed_at_both_ends(spark):
    p = 100 * HOUR
    ends = [p - HOUR - 1, p - HOUR, p + 5 * MINUTE, p + 5 * MINUTE + 1, p - 3 * HOUR, p - 3 * HOUR - 1]
    w = spark.createDataFrame([("A", e) for e in ends] + [("B", p)], "pair string, end_ms bigint")
    lab = spark.createDataFrame([("A", p)], "pair string, pump_ms bigint")
    got = {(r["pair"], r["end_ms"]): (r["y"], r["mask"]) for r in N.label_windows(w, lab).collect()}
    assert [got["A", e] for e in ends] == [(0, True), (1, False), (1, False), (0, True), (0, True), (0, False)]
    assert got["B", p] == (0, False)


def test_events_by_gap_across_midnight(spark):
    m = MINUTE
    rows = [("A", DAY - 10 * m), ("A", DAY + 55 * m), ("A", DAY + 121 * m), ("B", DAY + 122 * m)]
    w = spark.createDataFrame([(p, t, 1) for p, t in rows] + [("A", 5, 0)], "pair string, end_ms bigint, y int")
    got = {(r["pair"], r["end_ms"]): r["event_id"] for r in N.group_events(w, 65 * m).collect()}
    assert [got[k] for k in rows] == [0, 0, 1, 2]
    assert got["A", 5] == -1


def test_fuzzy_gap_of_exactly_thirty_minutes(spark):
    rows = [("A", 0, "x", "s"), ("A", 29 * MINUTE, "y", "s"), ("A", 59 * MINUTE, "z", "s")]
    lab = spark.createDataFrame(rows, "pair string, pump_ms bigint, grp string, source string")
    got = [(r["pump_ms"], r["grp"]) for r in V.fuzzy_dedup(lab).orderBy("pump_ms").collect()]
    assert got == [(0, "x|y"), (59 * MINUTE, "z")]


def test_dump_rows(spark):
    rows = [
        ("agg_trade_id", "price", "qty", "f", "l", "transact_time", "m", "b"),
        ("1", "2.5", "3", "1", "1", "1600000000000", "TRUE", "x"),
        ("2", "2.5", "3", "1", "1", "1735689600000123", "false", "x"),
        ("3", "", "3", "1", "1", "1600000000000", "1", "x"),
        ("4", "1", "3", "1", "1", None, "1", "x"),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in T.DUMP_COLUMNS))
    got = {r["agg_id"]: (r["time"], r["is_buyer_maker"]) for r in T.ingest_agg_trades(df).collect()}
    assert got == {1: (1600000000000, True), 2: (1735689600000, False)}


def scored(spark, y, s, pair="A"):
    rows = [("m", pair if isinstance(pair, str) else pair[i], i * 1000, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))]
    return spark.createDataFrame(rows, "tag string, pair string, end_ms bigint, y int, score double")


def test_ranking_metrics_with_ties_and_one_class(spark):
    r = E.ranking_metrics(scored(spark, [1, 0, 1, 0], [0.9, 0.9, 0.5, 0.1]), ["tag"]).first()
    # pairs: 1 tie counts half, (0.9,0.1) (0.5,0.1) won, (0.5,0.9) lost
    assert r["roc_auc"] == pytest.approx(2.5 / 4)
    assert r["pr_auc"] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3, abs=1e-4)
    one = E.ranking_metrics(scored(spark, [1, 1], [0.9, 0.1]), ["tag"]).first()
    assert one["roc_auc"] is None


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_threshold_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    y = (rng.random(400) < 0.2).astype(int)
    s = np.round(rng.normal(y * 1.0, 1.0), 2)
    lo, hi = np.percentile(s, 0.5), np.percentile(s, 99.9)
    grid = [hi if i == 299 else lo + i * ((hi - lo) / 299) for i in range(300)]
    f1 = []
    for t in grid:
        tp, fp, fn = ((s >= t) & (y == 1)).sum(), ((s >= t) & (y == 0)).sum(), ((s < t) & (y == 1)).sum()
        f1.append(2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0)
    r = E.tune_threshold(scored(spark, y, s), ["tag"]).first()
    assert r["thr"] == pytest.approx(grid[int(np.argmax(f1))], abs=1e-12)
    assert r["f1"] == pytest.approx(max(f1), abs=1e-12)


def test_threshold_of_constant_scores_without_positives(spark):
    r = E.tune_threshold(scored(spark, [0, 0, 0], [0.5, 0.5, 0.5]), ["tag"]).first()
    assert (r["thr"], r["f1"]) == (0.5, 0.0)


def test_bootstrap_leaves_out_draws_without_positives(spark):
    s = scored(spark, [1, 1, 0, 0], [1.0, 0.0, 0.0, 0.0], ["A", "A", "B", "B"]).withColumn("pred", F.col("score").cast("int"))
    d = E.bootstrap_draws(s, ["tag"], 200, 0).toPandas()
    assert 0 < len(d) < 200
    none = s.withColumn("y", F.lit(0))
    assert E.bootstrap_ci(none, ["tag"], 50).count() == 0


def test_ks_against_numpy(spark):
    rng = np.random.default_rng(3)
    a, b = np.round(rng.normal(0, 1, 500), 1), np.round(rng.normal(0.2, 1, 300), 1)
    grid = np.union1d(a, b)
    want = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    fa, fb = (spark.createDataFrame(pd.DataFrame({"v": x})) for x in (a, b))
    r = E.ks_two_sample(fa, fb, "v").first()
    assert r["statistic"] == pytest.approx(want, abs=1e-12)
    few = E.ks_two_sample(fa.limit(100), fb, "v").first()
    assert few["statistic"] is None


def test_quantiles_and_running_totals_against_numpy(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(0, 5, 999), np.zeros(500), -np.exp(rng.normal(0, 9, 200))])
    df = spark.createDataFrame(pd.DataFrame({"k": ["a"] * len(v), "v": v, "i": range(len(v))}))
    r = exact_quantiles(df, ["k"], "v", {"lo": 0.005, "mid": 0.5, "hi": 0.999}).first()
    for n, q in (("lo", 0.005), ("mid", 0.5), ("hi", 0.999)):
        assert r[n] == pytest.approx(np.quantile(v, q), rel=1e-12)
    from tapewatch.functions.keys import radix_bucket

    g = df.groupBy("k", "v").count()
    got = running_totals(g, ["k"], radix_bucket("v"), ["v"], {"c": "count"}).orderBy("v").toPandas()
    assert list(got["c"]) == list(np.cumsum(got["count"]))
    top = smallest_keys(df, ["k"], radix_bucket("v"), ["v", "i"], F.lit(37)).toPandas()
    assert sorted(top["v"]) == sorted(v)[:37] and sorted(top["rank"]) == list(range(1, 38))


def test_rule_grid_against_brute_force(spark):
    rng = np.random.default_rng(1)
    a, b = np.round(rng.random(200) * 9, 2), np.round(rng.random(200) * 9, 2)
    y = (rng.random(200) < 0.3).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"max_z_ret": a, "max_z_vol": b, "y": y}))
    g = S.rule_grid(df).toPandas()
    assert len(g) == 961
    for _, r in g.sample(60, random_state=0).iterrows():
        hit = (a > r["a"]) & (b > r["b"])
        assert (r["tp"], r["fp"], r["fn"]) == ((hit & (y == 1)).sum(), (hit & (y == 0)).sum(), (~hit & (y == 1)).sum())


def test_manifest_diff(spark):
    s = "grp string, path string, size bigint, sha256 string"
    want = spark.createDataFrame([("g", "a", 1, "x"), ("g", "b", 1, "x"), ("h", "a", 1, "x")], s)
    got = spark.createDataFrame([("g", "a", 1, "y"), ("g", "c", 1, "x"), ("h", "a", 1, "x")], s)
    r = {x["grp"]: (x["missing"], x["extra"], x["changed"], x["status"]) for x in D.manifest_diff(want, got).collect()}
    assert r == {"g": (1, 1, 1, "MISMATCH"), "h": (0, 0, 0, "OK")}


def test_hot_copies_collapse(spark):
    t = tape(spark, [1, 2, 3]).unionByName(tape(spark, [9]).withColumn("time", F.lit(5).cast("bigint")))
    for _ in range(5):
        t = t.unionByName(t)
    d = K.dedup_trades(t).orderBy("agg_id").collect()
    assert [(r["agg_id"], r["price"], r["time"]) for r in d] == [(0, 1.0, 0), (1, 2.0, 1000), (2, 3.0, 2000)]
