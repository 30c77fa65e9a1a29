"""Results must not depend on how the tape is cut into tasks."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewatch.config import FIXTURE
from tapewatch.operators import bars as B, clean as K, features as X, measures as M
from tapewatch.plans import dataset as P, fixture as fx

SMALL = FIXTURE.with_(sigma_window=20, sigma_min=8, tape_segment_rows=20, k0=1.5)
WHOLE = SMALL.with_(tape_segment_rows=10**9)


def rows(df, keys):
    return df.toPandas().sort_values(keys).reset_index(drop=True)


@pytest.mark.parametrize("mode", ["static", "adaptive"])
def test_cleaning_is_the_same_in_many_segments(spark, root, mode):
    t = fx.trades_dup(spark, root)
    a = rows(K.flag_trades(t, mode, SMALL), ["pair", "agg_id"])
    b = rows(K.flag_trades(t, mode, WHOLE), ["pair", "agg_id"])
    assert a["removed"].sum() > 0
    pd.testing.assert_frame_equal(a, b)


def test_tape_really_is_cut(spark, root):
    parts = K.tape_buckets(K.dedup_trades(fx.trades(spark, root)), SMALL, K.segment_rows(SMALL, SMALL.sigma_window))[1]
    place = K.tape_segments(parts, SMALL, SMALL.sigma_window)
    own = place.groupBy("pair", "chunk_id").agg(F.countDistinct("own").alias("n")).agg(F.min("n")).first()[0]
    assert own > 1
    # rows that no window needs are not repeated
    assert place.filter(F.size("segs") > 4).count() == 0


def hot_hour(spark, n=5000, one_ms=False):
    """One pair with ``n`` trades in an hour, some before and behind it."""
    import random

    rnd = random.Random(7)
    start = 1_700_000_000_000 // 3_600_000 * 3_600_000
    at = [start - 1 - rnd.randrange(3_600_000) for _ in range(60)] + [start + 3_600_000 + rnd.randrange(3_600_000) for _ in range(60)]
    at += [start + (5 if one_ms else rnd.randrange(3_600_000)) for _ in range(n)]
    rows = [("p", 10**12 + i * 3, 100 * (1 + rnd.choice([0, 0, 0.05]) + rnd.random() / 1000), 1.0, t, True) for i, t in enumerate(at)]
    return spark.createDataFrame(rows, "pair string, agg_id bigint, price double, qty double, time bigint, is_buyer_maker boolean")


@pytest.mark.parametrize("one_ms", [False, True])
def test_a_hot_hour_is_cut(spark, one_ms):
    t = hot_hour(spark, one_ms=one_ms)
    cfg = FIXTURE.with_(sigma_window=20, sigma_min=8, tape_segment_rows=100, k0=1.5)
    cut = K._cut(t, cfg, 1, None).filter("seg = own").groupBy("seg").count().toPandas()
    assert len(cut) >= 50 and cut["count"].max() <= 2 * 100
    for mode in ("static", "adaptive"):
        a = rows(K.flag_trades(t, mode, cfg), ["agg_id"])
        b = rows(K.flag_trades(t, mode, cfg.with_(tape_segment_rows=10**9)), ["agg_id"])
        assert len(a) == 5120 and a["removed"].sum() > 0
        pd.testing.assert_frame_equal(a, b)


def test_wide_ids_still_part_a_hot_hour(spark):
    t = hot_hour(spark, 1000).withColumn("agg_id", F.when(F.col("agg_id") % 2 == 0, F.col("agg_id")).otherwise(F.col("agg_id") + (1 << 60)))
    cfg = FIXTURE.with_(tape_segment_rows=100)
    got = K._cut(t, cfg, 1, None).filter("seg = own")
    order = [r.agg_id for r in got.orderBy("g").collect()]
    assert order == [r.agg_id for r in t.orderBy("time", "agg_id").collect()]
    assert got.groupBy("seg").count().agg(F.max("count")).first()[0] <= 250


def test_one_pass_flags_every_mode(spark, root):
    t = fx.trades_dup(spark, root)
    both = K.flag_modes(t, cfg=SMALL)
    for mode in ("none", "static", "adaptive"):
        a = rows(both.select(*K.KEEP, F.col(f"removed_{mode}").alias("removed")), ["pair", "agg_id"])
        pd.testing.assert_frame_equal(a, rows(K.flag_trades(t, mode, SMALL), ["pair", "agg_id"]))


def test_datasets_of_all_modes_equal_each_alone(spark, root):
    t, labels = fx.trades(spark, root), fx.pumps(spark, root)
    cfg = FIXTURE.with_(k0=1.5)
    every = P.build_datasets(t, labels, cfg, ["none", "adaptive"], stats=False)
    for mode in ("none", "adaptive"):
        one = P.build_dataset(t, labels, cfg, mode, stats=False)
        keys = ["pair", "end_ms"]
        pd.testing.assert_frame_equal(rows(every.filter(F.col("mode") == mode).select(*one.columns), keys), rows(one, keys), rtol=1e-9)


def test_wide_frames_by_blocks_across_segments(spark, root):
    t = K.dedup_trades(fx.trades(spark, root))
    cfg = FIXTURE.with_(sigma_window=20, sigma_min=8, tape_segment_rows=25)
    cut = K._cut(t, cfg, cfg.sigma_window, None)
    from tapewatch.functions.rolling import sliding_moments

    a = sliding_moments(cut, K.SEG, "rn", ["ret"], 20, "direct").filter("seg = own")
    b = sliding_moments(cut, K.SEG, "rn", ["ret"], 20, "blocks").filter("seg = own")
    a, b = (rows(d.select("pair", "agg_id", "ret__n", "ret__mean", "ret__sd"), ["pair", "agg_id"]) for d in (a, b))
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("size", [100, 333])
def test_features_and_windows_are_the_same_in_many_segments(spark, root, size):
    bars = P.tape_bars(fx.trades(spark, root), FIXTURE)
    keys = ["pair", "end_ms"]

    def run(cfg):
        f = X.bar_features(B.segment_bars(bars, cfg), cfg)
        return rows(M.window_measures(f, cfg, stats=False), keys)

    a, b = run(FIXTURE.with_(bar_segment_bars=size)), run(FIXTURE)
    assert len(a) > 100
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-9, atol=1e-9)


def test_window_not_a_multiple_of_the_stride(spark, root):
    """The oldest pane gives only its last bars: compare with plain frames."""
    from pyspark.sql import Window as W

    cfg = FIXTURE.with_(window_bars=22, stride_bars=4, late_bars=7, bar_segment_bars=200)
    f = X.bar_features(B.segment_bars(P.tape_bars(fx.trades(spark, root), cfg), cfg), cfg)
    got = rows(M.window_measures(f, cfg), ["pair", "end_ms"])
    own = f.filter("own")
    fr = W.partitionBy("pair", "chunk_id").orderBy("idx").rowsBetween(-21, 0)
    want = own.select(
        "pair", "idx", F.col("bar_ms").alias("end_ms"), F.avg("z_vol").over(fr).alias("z_vol_mean"),
        F.stddev_pop("z_vol").over(fr).alias("z_vol_std"), F.max("z_ret").over(fr).alias("max_z_ret"), F.min("ret").over(fr).alias("ret_min"),
    )
    want = rows(M.window_ends(want, cfg).drop("idx"), ["pair", "end_ms"])
    cols = ["pair", "end_ms", "z_vol_mean", "z_vol_std", "max_z_ret", "ret_min"]
    pd.testing.assert_frame_equal(got[cols], want[cols], check_exact=False, rtol=1e-9, atol=1e-9)


def test_plan_moves_bars_once(spark, root):
    """Segments, features and measures share one exchange."""
    bars = P.tape_bars(fx.trades(spark, root), FIXTURE)
    from tapewatch.session import staged

    b = staged(bars, "bars")
    w = M.window_measures(X.bar_features(B.segment_bars(b, FIXTURE), FIXTURE), FIXTURE, stats=False)
    plan = w._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    cut = next(i for i, x in enumerate(lines) if "REPARTITION_BY_COL" in x)
    # printed from the result down: nothing is exchanged after the segments are
    assert not [x for x in lines[:cut] if "Exchange" in x]


def test_no_row_is_lost_on_the_grid(spark, root):
    cfg = FIXTURE
    g = B.fill_bar_gaps(P.tape_bars(fx.trades(spark, root), cfg), cfg)
    per = g.groupBy("pair", "chunk_id").agg(
        F.count(F.lit(1)).alias("n"), ((F.max("bar_ms") - F.min("bar_ms")) / cfg.bar_ms + 1).alias("slots")
    )
    assert per.filter("n <> slots").count() == 0
