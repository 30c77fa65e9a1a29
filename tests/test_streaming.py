"""The live path against the batch path."""

import os
import subprocess
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tapewatch.config import FIXTURE, MINUTE
from tapewatch.operators import bars as B, features as X, measures as M
from tapewatch.plans import fixture as fx
from tapewatch.session import scratch_dir
from tapewatch.sources import trades as T
from tapewatch.streaming import live

MSG = "value string"


def messages(spark, folder, batches):
    """Each batch of trades in a file of its own, read one file per trigger."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "pair string, agg_id bigint, price double, qty double, time bigint, is_buyer_maker boolean")
        T.encode_trades(df).select("value").coalesce(1).write.mode("append").text(f"{folder}/b{i}")
    src = spark.readStream.schema(MSG).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").text(folder)
    return T.decode_trades(src)


def drain(spark, out, name):
    path = scratch_dir(spark, name)
    live.write_stream(out, f"{path}/c", available_now=True, path=f"{path}/d").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/d")


def test_late_trades_within_and_beyond_the_watermark(spark):
    cfg = FIXTURE.with_(bar_ms=5000)
    b1 = [("A", 1, 10.0, 1.0, 1_000, False), ("A", 2, 11.0, 1.0, 31_000, False)]
    b2 = [("A", 3, 12.0, 1.0, 2_000, True), ("A", 1, 10.0, 1.0, 1_000, False)]  # late but in time; a repeat
    b3 = [("A", 4, 13.0, 1.0, 120_000, False)]
    # with chained stateful steps rows are judged by the batch before's watermark
    b3b = [("A", 7, 13.5, 1.0, 121_000, False)]
    b4 = [("A", 5, 99.0, 1.0, 3_000, False), ("A", 6, 14.0, 1.0, 200_000, False)]  # too late
    t = messages(spark, scratch_dir(spark, "msgs"), [b1, b2, b3, b3b, b4])
    got = drain(spark, live.stream_bars(live.dedup_stream(t), cfg), "late").toPandas().set_index("bar_ms")
    assert list(sorted(got.index)) == [0, 30_000, 120_000]
    assert (got.loc[0, "n_trades"], got.loc[0, "close"], got.loc[0, "high"]) == (2, 12.0, 12.0)


BARS = "pair string, bar_ms bigint, open double, high double, low double, close double, volume double, n_trades bigint, taker_buy_vol double, quote_vol double"


def bar_stream(spark, batches):
    """Each frame of bars in one file, read one file a trigger."""
    folder = scratch_dir(spark, "bars")
    for df in batches:
        df.select(*[c.split()[0] for c in BARS.split(", ")]).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(folder)


def scores_of(spark, batches, cfg, scorer, **kw):
    path = scratch_dir(spark, "scoring")
    live.start_scoring(bar_stream(spark, batches), f"{path}/out", f"{path}/c", scorer, cfg=cfg, available_now=True, **kw).awaitTermination()
    return path, spark.read.parquet(f"{path}/out/scores")


def test_later_bars_replace_stored_ones(spark):
    """Of a bar sent again in a later batch the later one counts; pairs that do not move send nothing."""
    row = lambda p, at, c: (p, at, 1.0, 1.0, 1.0, c, 1.0, 1, 1.0, 1.0)
    batches = [spark.createDataFrame(r, BARS) for r in ([row("A", 0, 1.0), row("B", 0, 5.0)], [row("A", 0, 2.0)], [row("A", 900_000, 3.0)])]
    seen = {}

    def keep(batch, epoch):
        seen[epoch] = sorted((r.pair, r.bar_ms, r.close, r.fresh) for r in batch.collect())

    recent = live.recent_bars(bar_stream(spark, batches), FIXTURE)
    recent.writeStream.foreachBatch(keep).option("checkpointLocation", scratch_dir(spark, "c")).trigger(availableNow=True).start().awaitTermination()
    got = [v for _, v in sorted(seen.items()) if v]
    assert got == [[("A", 0, 1.0, True), ("B", 0, 5.0, True)], [("A", 0, 2.0, True)], [("A", 0, 2.0, False), ("A", 900_000, 3.0, True)]]


def test_scoring_needs_no_state_setting_of_the_session(spark):
    """A session that names no state store, or one without keyed state, scores all the same and keeps its setting."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    plain = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    bars = spark.createDataFrame([("A", i * FIXTURE.bar_ms, 1.0 + i % 7, 9.0, 1.0, 2.0 + i % 5, 1.0, 1, 0.5, 1.5) for i in range(200)], BARS)
    spark.conf.set(name, plain)
    try:
        _, got = scores_of(spark, [bars], FIXTURE, lambda w: w.withColumn("score", F.col("max_z_ret")))
        assert got.count() > 0
        assert spark.conf.get(name) == plain
    finally:
        spark.conf.set(name, old)


def test_the_keyed_step_travels_by_value():
    """Spark starts it beside the driver too, where this package may not be found."""
    sent = cloudpickle.dumps(live._recent_processor(10, None))
    code = "import sys, pickle; p = pickle.load(sys.stdin.buffer); assert 'tapewatch' not in sys.modules; print(type(p).__name__)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], input=sent, cwd="/", env=env, capture_output=True, timeout=120)
    assert (done.returncode, done.stdout.strip()) == (0, b"RecentBars"), done.stderr


def test_scoring_starts_no_worker_beside_the_driver(spark):
    """No keyed step that needs a state server, protocol buffers and a worker beside the driver; bars a stream aggregates are scored too."""
    rows = [[("A", i * 50 + j, 1.0 + j % 7, 1.0, (i * 50 + j) * FIXTURE.bar_ms, False) for j in range(50)] for i in range(4)]
    trades = live.dedup_stream(messages(spark, scratch_dir(spark, "msgs"), rows))
    path = scratch_dir(spark, "relay")
    closing, closed = live.relay_bars(live.stream_bars(trades, FIXTURE), f"{path}/bars", f"{path}/b", available_now=True)
    closing.awaitTermination()
    steps = live.recent_bars(closed, FIXTURE)._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in steps
    q = live.start_scoring(closed, f"{path}/out", f"{path}/c", lambda w: w.withColumn("score", F.col("max_z_ret")), cfg=FIXTURE, available_now=True)
    q.awaitTermination()
    bars = spark.read.parquet(f"{path}/bars")
    got = spark.read.parquet(f"{path}/out/scores")
    assert bars.count() > 190 and got.count() > 100
    assert got.join(bars, (bars.pair == got.pair) & (bars.bar_ms == got.end_ms), "left_anti").isEmpty()


def test_idle_state_leaves_only_running_streams(spark):
    bars = bar_stream(spark, [spark.createDataFrame([("A", 0, 1.0, 1.0, 1.0, 1.0, 1.0, 1, 1.0, 1.0)], BARS)])
    with pytest.raises(ValueError):
        live.start_scoring(bars, "x", "y", lambda w: w, available_now=True, ttl_ms=1000)
    assert live.recent_bars(bars, FIXTURE, ttl_ms=1000).isStreaming


def test_thin_pairs_are_scored_from_their_last_bars(spark):
    """Bars of a pair further apart than the whole buffer: its re-grid spans enough bars from the second one on."""
    cfg = FIXTURE.with_(z_window=24, window_bars=8, vol_window=12)
    bars = spark.createDataFrame([("A", i * 157 * cfg.bar_ms, 1.0 + i, 2.0 + i, 1.0, 1.5 + i, 1.0, 1, 0.5, 1.5) for i in range(4)], BARS)
    scorer = lambda w: w.withColumn("score", F.col("max_z_vol"))
    want = {r.end_ms: r.max_z_vol for r in live.online_windows(bars, cfg).collect()}
    _, got = scores_of(spark, [bars.filter(F.col("bar_ms") == i * 157 * cfg.bar_ms) for i in range(4)], cfg, scorer)
    got = {r.end_ms: r.score for r in got.collect()}
    assert sorted(got) == [i * 157 * cfg.bar_ms for i in (1, 2, 3)]
    assert all(abs(got[t] - want[t]) < 1e-9 for t in got)


def test_online_scores_equal_batch(spark, root):
    """Windows scored in two micro-batches equal those of one batch run."""
    cfg = FIXTURE.with_(z_window=24, window_bars=8, vol_window=12)
    bars = B.trades_to_bars(fx.trades(spark, root), cfg)
    lo, hi = bars.agg(F.min("bar_ms"), F.max("bar_ms")).first()
    mid = (lo + hi) // 2
    scorer = lambda w: w.withColumn("score", F.col("max_z_ret"))
    # both halves of the tape on one grid per pair
    whole = live.online_windows(bars, cfg).select("pair", "end_ms", F.col("max_z_ret").alias("want"))
    path, got = scores_of(spark, [bars.filter(F.col("bar_ms") <= mid), bars.filter(F.col("bar_ms") > mid)], cfg, scorer, threshold=1.5)
    both = got.toPandas().merge(whole.toPandas(), on=["pair", "end_ms"])
    assert (both["end_ms"] > mid).sum() > 50 and len(both) == got.count()
    assert ((both["score"] - both["want"]).abs() < 1e-9).all()
    assert (both["age_ms"] > 0).all()
    assert spark.read.json(f"{path}/out/alerts").count() == (both["score"] >= 1.5).sum() > 0


def test_a_stored_model_scores_a_stream(spark, root):
    """Saved, loaded and applied to micro-batches, a model gives what it gave before it was saved."""
    from tapewatch.operators import models as L
    from tapewatch.plans import dataset as P
    from tapewatch.sources import detectors as D

    w = P.build_dataset(fx.trades(spark, root), fx.pumps(spark, root), FIXTURE, "none")
    model = L.fit_microstructure(w.filter("split = 'train'"))
    store = scratch_dir(spark, "detectors")
    D.save_detector(store, "micro", model, 0.25, spark)
    D.save_detector(store, "micro", model, 0.75, spark)  # replaces it
    d = D.load_detector(spark, store, "micro")
    assert (d.threshold(), d.threshold(0.1), D.Detector("x", model, None).threshold()) == (0.75, 0.1, 0.5)
    assert [tuple(r) for r in D.stored_detectors(spark, store).collect()] == [("micro", 0.75)]
    bars = B.trades_to_bars(fx.trades(spark, root), FIXTURE)
    want = L.score_model(model, live.online_windows(bars, FIXTURE)).select("pair", "end_ms", F.col("score").alias("want")).toPandas()
    _, got = scores_of(spark, [bars], FIXTURE, d.score, threshold=d.threshold(), model=d.name)
    both = got.toPandas().merge(want, on=["pair", "end_ms"])
    # windows end at every slot of the grid; the stream scores those that end at a bar
    assert len(both) == got.count() > 100 and ((both["score"] - both["want"]).abs() < 1e-9).all()


def test_late_trades_are_counted(spark):
    rows = [[("A", i, 1.0, 1.0, t, False)] for i, t in enumerate((0, 500_000, 600_000, 1_000, 700_000))]
    t = messages(spark, scratch_dir(spark, "msgs"), rows)
    listener = live.Throughput()
    spark.streams.addListener(listener)
    path = scratch_dir(spark, "late")
    q = live.write_stream(live.observed_lag(live.dedup_stream(t).withColumn("bar_ms", F.col("time"))), f"{path}/c", available_now=True, path=f"{path}/d")
    q.awaitTermination()
    got = listener.of(q)
    spark.streams.removeListener(listener)
    assert (got["trades"], got["late"]) == (5, 1)
    seen = listener.metrics(q, "lag")
    assert sum(m["bars"] for m in seen) == 4 and max(m["newest_ms"] or 0 for m in seen) == 700_000


def test_latency_needs_more_than_ten(spark):
    f = spark.range(10).select(F.col("id").alias("end_ms"), F.col("id").alias("age_ms"))
    assert live.latency_percentiles(f).first()["p50"] == 0.0
    f = spark.range(2000).select(F.col("id").alias("end_ms"), F.col("id").alias("age_ms"))
    r = live.latency_percentiles(f).first()
    assert (r["n"], r["p50"]) == (1000, pytest.approx(1499.5))


def test_alert_rows(spark):
    s = spark.createDataFrame([("A", MINUTE, 0.91234), ("A", 2 * MINUTE, 0.1)], "pair string, end_ms bigint, score double")
    r = live.online_alerts(s, 0.5, "m").collect()
    assert [(x["symbol"], x["score"], x["threshold"], x["model"]) for x in r] == [("A", 0.9123, 0.5, "m")]
    msg = live.alert_messages(live.online_alerts(s, 0.5, "m")).first()
    assert msg["key"] == "A" and '"score":0.9123' in msg["value"]


def test_features_do_not_know_their_source(spark, root):
    bars = B.trades_to_bars(fx.trades(spark, root), FIXTURE)
    sent = live.decode_bars(live.bar_messages(bars))
    a, b = (
        X.bar_features(B.segment_bars(d.withColumn("chunk_id", F.lit(0)), FIXTURE), FIXTURE).filter("own").toPandas()
        .sort_values(["pair", "bar_ms"]).reset_index(drop=True)
        for d in (bars, sent)
    )
    pd.testing.assert_frame_equal(a, b)
    assert M.STATS
