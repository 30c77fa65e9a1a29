"""Ranks over crowded values, stores written twice, and inputs outside the test tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewatch.config import FIXTURE as C
from tapewatch.functions.ranking import even_buckets, exact_quantiles, running_totals
from tapewatch.operators import clean as K, evaluate as E
from tapewatch.plans import dataset as P, fixture as fx
from tapewatch.session import scratch_dir
from tapewatch.sources import datasets as D, labels as LB


@pytest.fixture(scope="module")
def crowded(spark):
    """Saturated scores: sigmoids of logits from 5 to 15."""
    n = 40_000
    s = spark.range(n).select(F.lit("m").alias("tag"), (F.lit(1.0) / (1 + F.exp(-(5 + F.col("id") * 10 / n)))).alias("score"))
    return s.cache()


def test_no_bucket_holds_much_of_a_crowded_range(crowded):
    b = even_buckets(crowded, ["tag"], "score", "b", ["score"]).groupBy("b").count()
    assert b.agg(F.max("count")).first()[0] <= 0.05 * crowded.count()


def test_ranks_of_crowded_scores_are_exact(crowded):
    c = crowded.groupBy("tag", "score").agg(F.count("*").alias("n"))
    c = even_buckets(c, ["tag"], "score", "b", ["score"])
    got = running_totals(c, ["tag"], "b", ["score"], {"upto": "n"}).select("score", "n", "upto").toPandas().sort_values("score")
    assert (got["upto"].to_numpy() == got["n"].cumsum().to_numpy()).all()
    q = {"a": 0.01, "b": 0.5, "c": 0.999}
    r = exact_quantiles(crowded, ["tag"], "score", q).first()
    want = np.quantile(crowded.select("score").toPandas()["score"], list(q.values()))
    assert [r[k] for k in q] == pytest.approx(want, abs=1e-15)


def test_quantiles_join_before_they_group(crowded):
    plan = exact_quantiles(crowded, ["tag"], "score", {"a": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    top = [x.strip(" +-:") for x in plan.splitlines()]
    last_join = max(i for i, x in enumerate(top) if x.startswith("Join"))
    by_value = [i for i, x in enumerate(top) if x.startswith("Aggregate") and "__v" in x.split("]")[0]]
    assert by_value and min(by_value) < last_join


def test_infinite_and_missing_scores(spark):
    inf = float("inf")
    rows = [("t", i, float(v), y) for i, (v, y) in enumerate([(-inf, 0), (-1, 0), (0, 1), (2, 0), (3, 1), (inf, 1)])]
    s = spark.createDataFrame(rows, "tag string, end_ms bigint, score double, y int")
    r = E.ranking_metrics(s, ["tag"]).first()
    # pairs of a positive and a negative: 8 of 9 in the right order
    assert r["roc_auc"] == pytest.approx(8 / 9, abs=1e-4)
    b = even_buckets(s.union(spark.createDataFrame([("t", 9, float("nan"), 0)], s.schema)), ["tag"], "score", "b", ["end_ms"])
    got = [x.end_ms for x in b.orderBy("b", "score").collect()]
    assert got == [0, 1, 2, 3, 4, 5, 9]


def test_full_eval_without_runs(spark, root):
    s = spark.range(400).select(
        F.concat(F.lit("p"), (F.col("id") % 7).cast("string")).alias("pair"), (F.col("id") * 60_000).alias("end_ms"),
        (F.col("id") % 5 == 0).cast("int").alias("y"), (F.col("id") % 5 == 0).cast("double").alias("score"),
    )
    labels = spark.createDataFrame([("p0", 600_000)], "pair string, pump_ms bigint")
    one = E.full_eval(s, s, labels, C, (), 50).collect()
    tagged = E.full_eval(s.withColumn("tag", F.lit("x")), s.withColumn("tag", F.lit("x")), labels, C, ("tag",), 50).drop("tag").collect()
    assert len(one) == 1 and one[0]["f1"] == 1.0 and one[0].asDict() == tagged[0].asDict()


def test_stats_count_active_days_only(spark, root):
    t = fx.trades(spark, root)
    chunks = K.chunk_map(K.day_summary(t))
    days = K.filter_active(chunks, chunks.agg(F.max("chunk_trades")).first()[0])
    r = K.cleaning_stats(K.flag_modes(t, ["none"], C, days), fx.pumps(spark, root), C, ["none"]).first()
    assert 0 < r["ticks_in"] == r["ticks_out"] < t.count() and r["removed"] == 0


def test_the_whole_tape_is_read(spark, root):
    t = fx.trades(spark, root)
    assert t.count() == spark.read.parquet(f"{root}/events.parquet").count()
    per_pair = K.chunk_map(K.day_summary(t)).groupBy("pair").agg(F.countDistinct("chunk_id").alias("n"))
    assert {r.n for r in per_pair.collect()} == {3}
    kept = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert fx.trades(spark, root).agg(F.sum("time")).first()[0] == t.agg(F.sum("time")).first()[0]
        feed = LB.normalize_labels(fx.label_feed(spark, root), "BTC").select("pump_ms").distinct()
        assert feed.join(fx.pumps(spark, root), "pump_ms", "left_anti").count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", kept)


def test_datasets_and_results_written_twice(spark, root):
    path = scratch_dir(spark, "twice")
    w = P.build_dataset(fx.trades(spark, root), fx.pumps(spark, root), C, "none", stats=True)
    stats = spark.createDataFrame([("none", 5), ("static", 7)], "mode string, removed int")
    for _ in range(2):
        D.write_dataset(w, stats, path)
    assert spark.read.parquet(f"{path}/windows").count() == w.count()
    assert [D.read_stats(spark, path, m).first()["removed"] for m in ("none", "static")] == [5, 7]
    rows = spark.createDataFrame([("a_s1", 0.5), ("a_s2", 0.6)], "tag string, f1 double")
    for _ in range(2):
        D.write_result(rows, f"{path}/results", "none")
    assert D.read_results(spark, f"{path}/results", "none").count() == 2


def test_label_times(spark):
    cols = "symbol string, `group` string, date string, hour string, exchange string"
    rows = [("abc", "g", "2018-01-05", "7:05 PM", "Binance"), ("abc", "g", "05 Jan 2018", "19:00", "binance")]
    got = {r.pump_ms for r in LB.normalize_labels(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1515179100000, 1515178800000}
    with pytest.raises(Exception, match="unknown date"):
        LB.normalize_labels(spark.createDataFrame([("abc", "g", "someday", "soon", "binance")], cols)).collect()


def test_digests_of_files_in_chunks(spark, tmp_path):
    import hashlib

    from tapewatch.sources import datasets as D

    sizes = {"a.bin": 1, "b.bin": 5, "odd name + 1.bin": 20_000}
    for name, n in sizes.items():
        (tmp_path / name).write_bytes(bytes(i % 251 for i in range(n)))
    # a file over the 2 GB that one row of content could hold
    with open(tmp_path / "big.dat", "wb") as f:
        f.truncate((1 << 31) + 11)
    got = {r.path: r for r in D.file_manifest(spark, {"small": f"{tmp_path}/*.bin"}, chunk=7).collect()}
    for name, n in sizes.items():
        assert (got[name].size, got[name].sha256) == (n, hashlib.sha256((tmp_path / name).read_bytes()).hexdigest())
    big = D.file_manifest(spark, {"big": f"{tmp_path}/*.dat"}, chunk=1 << 20)
    h = hashlib.sha256()
    for _ in range(1 << 11):
        h.update(bytes(1 << 20))
    h.update(bytes(11))
    assert big.first().sha256 == h.hexdigest()


def test_runs_by_cells_equal_runs_one_by_one(spark):
    """Result rows from counts by score cell equal those of each run evaluated alone."""
    from tapewatch.operators import evaluate as E

    rows = [(p, i * C.bar_ms, int(i % 17 < 3), m, round(((i * 7919 + len(p) * 31 + len(m)) % 997) / 997 + (0.4 if i % 17 < 3 else 0.0), 2))
            for p in ("A", "BB", "CCC") for m in ("x", "yy") for i in range(200)]
    test = spark.createDataFrame(rows, "pair string, end_ms bigint, y int, model string, score double")
    labels = spark.createDataFrame([("A", 40 * C.bar_ms), ("BB", 90 * C.bar_ms), ("CCC", 180 * C.bar_ms)], "pair string, pump_ms bigint")
    spec = F.inline(F.array(*[F.struct(F.lit(f).alias("label_frac"), F.lit(s).alias("seed")) for f in (0.5, 1.0) for s in (0, 1)]))
    many = test.select("*", spec)
    val = many.filter(F.pmod(F.xxhash64("pair", "end_ms", "seed"), F.lit(4)) < 4 * F.col("label_frac"))
    by = ["model", "label_frac", "seed"]
    want = E.full_eval(many, val, labels, C, by, 50).toPandas().sort_values(by).reset_index(drop=True)
    got = E.full_eval_runs(test, val, labels, C, "model", by[1:], 50).toPandas().sort_values(by).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)
    assert want["thr"].nunique() > 2


def test_tensors_are_whole_windows(spark, root):
    """Stored arrays equal the windows' bars, plain and standardised over the whole array."""
    from tapewatch.config import FEATURES
    from tapewatch.operators import windows as N
    from tapewatch.plans import dataset as P
    from tapewatch.session import scratch_dir, staged
    from tapewatch.sources import datasets as D

    path = scratch_dir(spark, "dataset")
    feats = staged(P.tape_features(fx.trades(spark, root), C), "features")
    win = staged(P.sampled_windows(feats, fx.pumps(spark, root), C, "none"), "sampled")
    D.write_dataset(win, None, path)
    for _ in range(2):  # a repeated run changes nothing
        D.write_tensors(feats, win, path, C)
    raw = D.read_tensors(spark, path, "none", "test", scaled=False)
    assert raw.count() == win.filter("split = 'test'").count() > 0
    assert raw.filter(F.size("x") != C.window_bars * len(FEATURES)).count() == 0
    last = D.tensor_rows(raw).filter(F.col("bar") == C.window_bars - 1)
    both = last.join(win.select("pair", "end_ms", *[F.col(f"{x}_last") for x in FEATURES]), ["pair", "end_ms"])
    worst = both.agg(*[F.max(F.abs(F.col(x) - F.col(f"{x}_last")) / (1 + F.abs(F.col(x)))) for x in FEATURES]).first()
    assert both.count() == raw.count() and max(worst) < 1e-6
    # every value of the train split, scaled, has mean 0 and deviation 1
    pool = D.tensor_rows(D.read_tensors(spark, path, "none", "train"))
    means = pool.agg(*[F.avg(x) for x in FEATURES], *[F.stddev_pop(x) for x in FEATURES]).first()
    sds = [v for v in means[10:] if v > 1e-3]
    assert max(abs(v) for v in means[:10]) < 1e-3 and sds and max(abs(v - 1) for v in sds) < 1e-2
    assert "y" not in D.read_tensor_pool(spark, path, "none").columns


def test_day_files(spark):
    """The layout {PAIR}/{date}.parquet: files without rows count as days, and a pair's filter opens its files alone."""
    from tapewatch.config import DAY
    from tapewatch.operators import clean as K
    from tapewatch.session import scratch_dir
    from tapewatch.sources import trades as T

    path = scratch_dir(spark, "day-files")
    rows = [("A+B", i, 1.0, 1.0, d * DAY + i, True) for i, d in enumerate((100, 100, 101, 104))] + [("C", 9, 1.0, 1.0, 100 * DAY, False)]
    t = spark.createDataFrame(rows, "pair string, agg_id bigint, price double, qty double, time bigint, is_buyer_maker boolean")
    for _ in range(2):
        T.write_day_files(t, path, spark.createDataFrame([("A+B", 102), ("A+B", 103), ("C", 101)], "pair string, day int"))
    files = T.day_files(spark, path)
    assert files.count() == 7 and files.filter("length > 0").count() == 7
    got = K.chunk_map(T.listed_days(files, T.read_trades(spark, path))).orderBy("pair", "day").collect()
    assert [(r.pair, r.day, r.n, r.chunk_id, r.chunk_trades) for r in got] == [
        ("A+B", 100, 2, 0, 4), ("A+B", 101, 1, 0, 4), ("A+B", 102, 0, 0, 4), ("A+B", 103, 0, 0, 4), ("A+B", 104, 1, 0, 4), ("C", 100, 1, 0, 1), ("C", 101, 0, 0, 1),
    ]

    def opened(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        leaves = plan.collectLeaves() if "AdaptiveSparkPlan" not in plan.nodeName() else plan.executedPlan().collectLeaves()
        return leaves.apply(0).metrics().apply("numFiles").value()

    assert opened(T.read_trades(spark, path).filter("pair = 'C'")) == 2
    assert opened(T.read_trades(spark, path, ["C"])) == 2
    assert opened(T.read_trades(spark, path).filter("pair = 'A+B' and file_day >= date'1970-04-14'")) == 2
