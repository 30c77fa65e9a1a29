"""Evaluation of scored windows (y, score, pair, end_ms), per run.

``by`` names the columns that tell runs apart, so many methods, seeds or
fractions are evaluated in one job; it may be empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import DEFAULT, HOUR, Settings
from ..functions.keys import day_of, draw_int, draw_key, floor_to, key_bucket
from ..functions.ranking import attach, even_buckets, exact_quantiles, running_totals, smallest_keys
from ..session import staged

SPREAD = ["pair", "end_ms"]


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    d = 2 * tp + fp + fn
    return F.when(d > 0, 2 * tp / d).otherwise(0.0)


# ------------------------------------------------------------- thresholds
def tune_threshold(scored: DataFrame, by: Sequence[str] = (), grid: int = 300) -> DataFrame:
    """by..., thr, f1: the grid point with the best F1, the first of equals.

    The grid runs evenly from the 0.5 % to the 99.9 % quantile. Scores are
    counted per grid cell; a point's positives are those in its cell or above.
    """
    by = list(by)
    q = exact_quantiles(scored, by, "score", {"lo": 0.005, "hi": 0.999})
    s = attach(scored.select(*by, *SPREAD, "y", "score"), q, by, SPREAD)
    lo, hi, x = F.col("lo"), F.col("hi"), F.col("score")
    step = (hi - lo) / (grid - 1)
    point = lambda k: F.when(k == grid - 1, hi).otherwise(lo + k * step)
    guess = F.when(step > 0, F.floor((x - lo) / step)).otherwise(F.when(x >= lo, grid - 1).otherwise(-1))
    s = s.withColumn("__k", F.least(F.greatest(guess, F.lit(-1)), F.lit(grid - 1)).cast("bigint"))
    k = F.col("__k")
    # rounding may put the guess one cell off; the points themselves decide
    k = F.when((k < grid - 1) & (x >= point(k + 1)), k + 1).when((k >= 0) & (x < point(k)), k - 1).otherwise(k)
    s = s.withColumn("__k", k)
    cells = s.groupBy(*by, "__k").agg(
        F.sum("y").cast("bigint").alias("p"), F.count(F.lit(1)).alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi")
    )
    part = W.partitionBy(*by, F.lit(0))
    above = part.orderBy(F.desc("__k")).rowsBetween(W.unboundedPreceding, 0)
    cells = cells.withColumns(
        {
            "tp": F.sum("p").over(above),
            "called": F.sum("n").over(above),
            "total": F.sum("p").over(part),
            # an empty cell has the counts of the next filled one
            "first": F.coalesce(F.lag("__k").over(part.orderBy("__k")) + 1, F.lit(0)),
        }
    ).filter("__k >= 0")
    f1 = f1_of(F.col("tp"), F.col("called") - F.col("tp"), F.col("total") - F.col("tp"))
    cells = cells.select(*by, "first", "lo", "hi", f1.alias("f1"))
    best = cells.groupBy(*by).agg(
        F.min_by(F.struct("first", "lo", "hi", "f1"), F.struct(-F.col("f1"), F.col("first"))).alias("b")
    )
    best = best.select(*by, "b.*")
    return best.select(*by, point(F.col("first")).alias("thr"), "f1")


def with_prediction(
    scored: DataFrame, thr: DataFrame, by: Sequence[str] = (), also: Sequence[str] = ()
) -> DataFrame:
    s = attach(scored, thr.select(*by, "thr", *also), list(by), SPREAD)
    return s.withColumn("pred", (F.col("score") >= F.col("thr")).cast("int"))


# ----------------------------------------------------------- window level
def window_metrics(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """precision, recall, f1 of ``pred``; 0 where the denominator is 0."""
    return _rates(_outcomes(pred, by), by)


def _outcomes(pred: DataFrame, by: Sequence[str]) -> DataFrame:
    p, y = F.col("pred"), F.col("y")
    return pred.groupBy(*by).agg(F.sum(p * y).alias("tp"), F.sum(p * (1 - y)).alias("fp"), F.sum((1 - p) * y).alias("fn"))


def _rates(g: DataFrame, by: Sequence[str]) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.select(
        *by,
        F.round(F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0), 4).alias("precision"),
        F.round(F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0), 4).alias("recall"),
        F.round(f1_of(tp, fp, fn), 4).alias("f1"),
    )


def _curve(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per distinct score: positives and rows, and both counted from the top."""
    c = scored.groupBy(*by, "score").agg(F.sum("y").cast("bigint").alias("p"), F.count(F.lit(1)).alias("n"))
    c = even_buckets(c, by, "score", "__even", ["score"])
    return running_totals(c, by, "__even", ["score"], {"tp": "p", "called": "n"}, descending=True).drop("__even")


def ranking_metrics(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """roc_auc (ties count half) and pr_auc (step rule); null with one class."""
    c = _curve(scored, list(by))
    p, n, tp, called = (F.col(x) for x in ("p", "n", "tp", "called"))
    neg = n - p
    g = c.groupBy(*by).agg(
        F.sum(neg * (tp - p) + neg * p / 2).alias("area"),
        F.sum(p * tp / called).alias("steps"),
        F.sum("p").alias("P"),
        F.sum(neg).alias("N"),
    )
    both = (F.col("P") > 0) & (F.col("N") > 0)
    return g.select(
        *by,
        F.round(F.when(both, F.col("area") / (F.col("P") * F.col("N"))), 4).alias("roc_auc"),
        F.round(F.when(both, F.col("steps") / F.col("P")), 4).alias("pr_auc"),
    )


# ------------------------------------------------------------ event level
def event_hits(
    pred: DataFrame, labels: DataFrame, cfg: Settings = DEFAULT, by: Sequence[str] = (), what: str = "pred"
) -> DataFrame:
    """by..., pair, pump_ms, detected: the events with a window in [t-pre, t+during], and their greatest ``what``."""
    width = cfg.pre_ms + cfg.during_ms
    spans = labels.select("pair", "pump_ms").withColumn(
        "bucket",
        F.explode(
            F.sequence(
                floor_to(F.col("pump_ms") - cfg.pre_ms, width), floor_to(F.col("pump_ms") + cfg.during_ms, width), F.lit(width)
            )
        ),
    )
    p = pred.select(*by, "pair", "end_ms", what, floor_to("end_ms", width).alias("bucket"))
    hit = p.join(spans, ["pair", "bucket"]).filter(
        (F.col("end_ms") >= F.col("pump_ms") - cfg.pre_ms) & (F.col("end_ms") <= F.col("pump_ms") + cfg.during_ms)
    )
    return hit.groupBy(*by, "pair", "pump_ms").agg(F.max(what).alias("detected"))


def event_metrics(pred: DataFrame, labels: DataFrame, cfg: Settings = DEFAULT, by: Sequence[str] = ()) -> DataFrame:
    """Event recall with its counts, and false alarms per symbol-day."""
    by = list(by)
    ev = event_hits(pred, labels, cfg, by)
    # per (pair, day) first, so counting days needs no distinct set in one task
    per = pred.groupBy(*by, "pair", day_of("end_ms").alias("day")).agg(F.sum(F.col("pred") * (1 - F.col("y"))).alias("fp"))
    return _event_rates(ev, per.groupBy(*by).agg(F.sum("fp").alias("fp"), F.count(F.lit(1)).alias("days")), by)


def _event_rates(ev: DataFrame, alarms: DataFrame, by: list[str]) -> DataFrame:
    """From detected events (by..., detected) and false alarms (by..., fp, days)."""
    ev = ev.groupBy(*by).agg(F.sum("detected").alias("d"), F.count(F.lit(1)).alias("t"))
    none = F.lit(0).cast("bigint")
    both = ev.select(*by, "d", "t", none.alias("fp"), none.alias("days")).unionByName(
        alarms.select(*by, none.alias("d"), none.alias("t"), "fp", "days")
    )
    g = both.groupBy(*by).agg(*[F.sum(x).alias(x) for x in ("d", "t", "fp", "days")])
    d, t = F.col("d"), F.col("t")
    return g.select(
        *by,
        F.round(d / F.greatest(t, F.lit(1)), 4).alias("event_recall"),
        d.cast("bigint").alias("events_detected"),
        t.cast("bigint").alias("events_total"),
        F.round(F.col("fp") / F.greatest("days", F.lit(1)), 3).alias("fa_per_symbol_day"),
    )


# -------------------------------------------------------------- bootstrap
def bootstrap_draws(pred: DataFrame, by: Sequence[str] = (), n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """by..., boot, f1: F1 of resamples of pairs with replacement.

    Each pair collapses to (tp, fp, fn) before anything is drawn. Draw (boot,
    slot) picks the pair whose rank a hash names; resamples without positives
    are left out.
    """
    return _draws(_outcomes(pred, [*by, "pair"]), list(by), n_boot, seed)


def _draws(per: DataFrame, by: list[str], n_boot: int, seed: int) -> DataFrame:
    total = per.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"))
    per = attach(per.withColumn("__key", draw_key(0, "pair")), total, by, ["pair"])
    per = smallest_keys(per, by, key_bucket("__key"), ["__key"], "pairs").withColumn("slot", F.col("rank") - 1)
    boots = per.select(*by, "slot", "pairs").withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    pick = F.pmod(draw_int(seed, "boot", "slot"), F.col("pairs"))
    boots = boots.select(*by, "boot", pick.alias("slot"))
    g = boots.join(per.select(*by, "slot", "tp", "fp", "fn"), [*by, "slot"])
    g = g.groupBy(*by, "boot").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    g = g.filter(F.col("tp") + F.col("fn") > 0)
    return g.select(*by, "boot", f1_of(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))


def bootstrap_ci(pred: DataFrame, by: Sequence[str] = (), n_boot: int = 1000, seed: int = 0) -> DataFrame:
    return _interval(bootstrap_draws(pred, by, n_boot, seed), by)


def _interval(draws: DataFrame, by: Sequence[str]) -> DataFrame:
    # at most n_boot values per run reach the percentile
    q = F.percentile("f1", F.array(F.lit(0.025), F.lit(0.975)))
    g = draws.groupBy(*by).agg(q.alias("q"))
    return g.select(*by, F.round(F.col("q")[0], 4).alias("f1_lo"), F.round(F.col("q")[1], 4).alias("f1_hi"))


def full_eval(
    test: DataFrame, val: DataFrame, labels: DataFrame, cfg: Settings = DEFAULT, by: Sequence[str] = ("tag",), n_boot: int = 1000
) -> DataFrame:
    """One result row per run: threshold from ``val``, everything else on ``test``."""
    by = list(by)
    if not by:
        one = F.lit(0).alias("__run")
        return full_eval(test.select("*", one), val.select("*", one), labels, cfg, ["__run"], n_boot).drop("__run")
    thr = tune_threshold(val, by).withColumnRenamed("f1", "val_f1")
    # read by every part below
    pred = staged(with_prediction(test, thr.select(*by, "thr", "val_f1"), by, ["val_f1"]), "predicted")
    out = window_metrics(pred, by)
    kept = pred.groupBy(*by).agg(F.max("thr").alias("thr"), F.max("val_f1").alias("val_f1"))
    for part in (ranking_metrics(pred, by), event_metrics(pred, labels, cfg, by), bootstrap_ci(pred, by, n_boot), kept):
        out = out.join(part, by, "left")
    return out.withColumns({"thr": F.round("thr", 6), "val_f1": F.round("val_f1", 4)})


def full_eval_runs(
    test: DataFrame, val: DataFrame, labels: DataFrame, cfg: Settings = DEFAULT, model: str = "model",
    runs: Sequence[str] = ("label_frac", "seed"), n_boot: int = 1000,
) -> DataFrame:
    """:func:`full_eval` where many runs of a model differ in their threshold alone.

    ``val`` has the columns ``runs``, ``test`` has each window once a model. A
    window's cell is the number of its model's thresholds it reaches, so a run
    calls the cells from its threshold's rank on. Counts by pair and cell, and
    each event's greatest cell, serve all runs; no window is repeated for them.
    """
    by = [model, *runs]
    thr = staged(tune_threshold(val, by), "thresholds")  # a row a run
    cuts = thr.groupBy(model).agg(F.array_sort(F.collect_set("thr")).alias("__cuts"))
    cell = F.size(F.filter("__cuts", lambda c: c <= F.col("score"))).alias("cell")
    cells = staged(attach(test, cuts, [model], SPREAD).select(model, *SPREAD, "y", "score", cell), "cells")
    rank = F.array_position("__cuts", F.col("thr")).alias("__rank")
    ranks = staged(thr.join(cuts, model).select(*by, "thr", F.col("f1").alias("val_f1"), rank), "ranks")

    days = cells.groupBy(model, "pair", day_of("end_ms").alias("day"), "cell").agg(F.sum("y").cast("bigint").alias("p"), F.count(F.lit(1)).alias("n"))
    days = staged(days, "days")
    counts = days.groupBy(model, "pair", "cell").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).join(ranks, model)
    called = F.col("cell") >= F.col("__rank")
    total = lambda c, v: F.sum(F.when(c, v).otherwise(0))
    per = counts.groupBy(*by, "pair").agg(
        total(called, F.col("p")).alias("tp"), total(called, F.col("n") - F.col("p")).alias("fp"), total(~called, F.col("p")).alias("fn")
    )
    per = staged(per, "outcomes")
    sums = per.groupBy(*by).agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    n_days = days.select(model, "pair", "day").distinct().groupBy(model).agg(F.count(F.lit(1)).alias("days"))
    hits = event_hits(cells, labels, cfg, [model], "cell").join(ranks, model)
    hits = hits.withColumn("detected", (F.col("detected") >= F.col("__rank")).cast("int"))
    out = _rates(sums, by).join(ranks.drop("__rank"), by).join(ranking_metrics(cells, [model]), model, "left")
    for part in (_event_rates(hits, sums.join(n_days, model), by), _interval(_draws(per, by, n_boot, 0), by)):
        out = out.join(part, by, "left")
    return out.withColumns({"thr": F.round("thr", 6), "val_f1": F.round("val_f1", 4)})


# ------------------------------------------------------------------ tests
def ks_two_sample(a: DataFrame, b: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Largest distance of the two empirical distributions, over all rows.

    Null unless both sides have more than 100 values. The p-value is the
    asymptotic series.
    """
    by = list(by)
    side = lambda d, k: d.select(*by, F.col(column).alias("v"), F.lit(k).alias("k"))
    c = side(a, 0).unionAll(side(b, 1)).groupBy(*by, "v").agg(
        F.sum(1 - F.col("k")).alias("a"), F.sum("k").alias("b")
    )
    c = even_buckets(c, by, "v", "__even", ["v"])
    c = running_totals(c, by, "__even", ["v"], {"ca": "a", "cb": "b"}).drop("__even")
    n = c.groupBy(*by).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    # one more pass over the counted values, with the totals at hand
    g = attach(c, n, by, ["v"]).groupBy(*by).agg(
        F.max("n1").alias("n1"),
        F.max("n2").alias("n2"),
        F.max(F.abs(F.col("ca") / F.col("n1") - F.col("cb") / F.col("n2"))).alias("ks"),
    )
    enough = (F.col("n1") > 100) & (F.col("n2") > 100)
    lam = F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2"))) * F.col("ks")
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(100)),
        lambda k: F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(-2.0 * k * k * lam * lam),
    )
    p = F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)
    p = F.when(F.col("ks") == 0, 1.0).otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))
    return g.select(
        *by, "n1", "n2", F.when(enough, F.col("ks")).alias("statistic"), F.when(enough, p).alias("p_value")
    )


def label_alignment(closes: DataFrame, counts: DataFrame, labels: DataFrame, around_ms: int = 2 * HOUR) -> DataFrame:
    """Per event: does the price rise after its label?

    ``closes``: one-minute closes; ``counts``: trades per pair. The minute of
    the event itself belongs to both sides.
    """
    width = around_ms
    spans = labels.select("pair", "pump_ms").withColumn(
        "bucket",
        F.explode(
            F.sequence(
                floor_to(F.col("pump_ms") - around_ms, width), floor_to(F.col("pump_ms") + around_ms, width), F.lit(width)
            )
        ),
    )
    c = closes.withColumn("bucket", floor_to("bar_ms", width))
    m = c.join(spans, ["pair", "bucket"]).filter(F.abs(F.col("bar_ms") - F.col("pump_ms")) <= around_ms)
    pre = F.when(F.col("bar_ms") <= F.col("pump_ms"), F.col("close"))
    post = F.when(F.col("bar_ms") >= F.col("pump_ms"), F.col("close"))
    g = m.groupBy("pair", "pump_ms").agg(
        F.count(F.lit(1)).alias("minutes"), F.avg(pre).alias("pre_mean"), F.max(post).alias("post_max")
    )
    out = labels.select("pair", "pump_ms").join(g, ["pair", "pump_ms"], "left").join(counts, "pair", "left")
    spike = F.when(F.col("pre_mean") != 0, (F.col("post_max") - F.col("pre_mean")) / F.col("pre_mean") * 100)
    spike = F.coalesce(spike, F.lit(0.0))
    usable = F.coalesce(F.col("minutes"), F.lit(0)) >= 10
    status = (
        F.when(F.coalesce(F.col("n"), F.lit(0)) < 100, "NO_DATA")
        .when(~usable, "INSUFFICIENT_DATA")
        .when(spike > 2.0, "ALIGNED")
        .otherwise("WEAK")
    )
    out = out.withColumn("status", status)
    known = F.col("status").isin("ALIGNED", "WEAK")
    return out.select("pair", "pump_ms", "status", F.when(known, F.round(spike, 6)).alias("spike_pct"))


def alignment_gate(aligned: DataFrame, limit: float = 0.7) -> DataFrame:
    good = F.sum((F.col("status") == "ALIGNED").cast("bigint"))
    usable = F.sum(F.col("status").isin("ALIGNED", "WEAK").cast("bigint"))
    return aligned.agg(good.alias("aligned"), usable.alias("usable")).withColumn(
        "passed", (F.col("usable") > 0) & (F.col("aligned") >= limit * F.col("usable"))
    )


def score_timeline(scored: DataFrame, around_ms: int = 2 * HOUR) -> DataFrame:
    """Scores around the first positive window."""
    first = scored.filter("y = 1").agg(F.min("end_ms").alias("center"))
    s = attach(scored, first, [], SPREAD)
    return s.filter(F.abs(F.col("end_ms") - F.col("center")) <= around_ms).drop("center")


