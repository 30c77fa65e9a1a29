"""Gates and tables over result rows.

Result rows have tag, precision, recall, f1, roc_auc, pr_auc, event_recall,
fa_per_symbol_day, f1_lo, f1_hi and, for repeated runs, model, label_frac, seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.datasets import is_seed_run, latest_results, seed_tag

WINDOW_COLS = ["precision", "recall", "f1", "roc_auc", "pr_auc"]
EVENT_COLS = ["event_recall", "fa_per_symbol_day"]
CI_COLS = ["f1_lo", "f1_hi"]
REPORT_COLS = WINDOW_COLS + EVENT_COLS + CI_COLS

# The comparison's methods in reporting order.
METHODS = [
    ("B1", "b1_rule"),
    ("B2", "b2_rushorder"),
    ("B3", "b3_microstructure"),
    ("B4", "b4_randomforest"),
    ("B5", "b5_logreg"),
    ("B6", "b6_xgboost"),
    ("B7", "b7_lstmae"),
    ("B8", "cnnbilstm_scratch"),
    ("B9", "at_scratch"),
    ("B10", "b10_at_unsup"),
    ("D", "at_pre"),
]


def _listed(df: DataFrame, rows: list[tuple], names: str) -> DataFrame:
    """A fixed list of rows as a frame, in order."""
    return df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"ord int, {names}")


def method_table(results: DataFrame, methods: list[tuple[str, str]] = METHODS) -> DataFrame:
    """One row per listed method in its order; nulls where it has no run."""
    r = latest_results(results).select(F.col("base").alias("method_tag"), *REPORT_COLS)
    m = _listed(results, methods, "method string, method_tag string")
    return m.join(r, "method_tag", "left").select("ord", "method", "method_tag", *REPORT_COLS)


def ablation_table(results: DataFrame, tag: str, modes: tuple[str, ...] = ("none", "static", "adaptive")) -> DataFrame:
    """One method across cleaning modes (``results`` has a mode column)."""
    r = results.filter(seed_tag(F.col("tag")) == tag)
    best = r.groupBy("mode").agg(
        F.max_by(F.struct(*REPORT_COLS), F.struct((F.col("tag") == tag).cast("int"), F.col("tag"))).alias("b")
    )
    m = _listed(results, [(x,) for x in modes], "mode string")
    return m.join(best.select("mode", "b.*"), "mode", "left").select("ord", "mode", *REPORT_COLS)


def seed_means(results: DataFrame, metric: str = "f1") -> DataFrame:
    """Per base tag: mean and population deviation over seed runs, NaN skipped."""
    v = F.when(~F.isnan(metric), F.col(metric))
    r = results.filter(is_seed_run(F.col("tag"))).withColumn("base", seed_tag(F.col("tag")))
    return r.groupBy("base").agg(
        F.count(v).alias("runs"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std")
    )


def seed_gate(results: DataFrame, candidate: str, control: str) -> DataFrame:
    """Does the candidate's mean F1 clear the control's mean upper bound?"""
    r = results.filter(is_seed_run(F.col("tag"))).withColumn("base", seed_tag(F.col("tag")))
    of = lambda t, c: F.when(F.col("base") == t, F.col(c))
    g = r.agg(
        F.count(of(candidate, "f1")).alias("n_candidate"),
        F.avg(of(candidate, "f1")).alias("a"),
        F.stddev_pop(of(candidate, "f1")).alias("a_std"),
        F.count(of(control, "f1")).alias("n_control"),
        F.avg(of(control, "f1")).alias("b"),
        F.stddev_pop(of(control, "f1")).alias("b_std"),
        F.avg(of(control, "f1_hi")).alias("b_hi"),
    )
    a, b, hi = F.round("a", 12), F.round("b", 12), F.round("b_hi", 12)
    verdict = (
        F.when((F.col("n_candidate") == 0) | (F.col("n_control") == 0), "MISSING")
        .when((a > b) & (a > hi), "PASS")
        .when(a > b, "MARGINAL")
        .otherwise("FAIL")
    )
    r6 = lambda c, n: F.round(c, 6).alias(n)
    return g.select(
        "n_candidate", r6("a", "candidate_mean"), r6("a_std", "candidate_std"),
        "n_control", r6("b", "control_mean"), r6("b_std", "control_std"), r6("b_hi", "control_hi"),
        (F.least("n_candidate", "n_control") < 3).alias("provisional"),
        verdict.alias("verdict"),
    )


def gate(value: Column, limit: float) -> Column:
    return F.when(value >= limit, "PASS").otherwise("FAIL")


def label_efficiency(results: DataFrame) -> DataFrame:
    """Per model and label fraction: F1 over seeds and mean event recall."""
    return results.groupBy("model", "label_frac").agg(
        F.count(F.lit(1)).alias("runs"),
        F.round(F.avg("f1"), 4).alias("mean"),
        F.round(F.stddev_pop("f1"), 4).alias("std"),
        F.array_join(F.array_sort(F.collect_list(F.format_string("%.4f", "f1"))), ",").alias("vals"),
        F.round(F.avg("event_recall"), 4).alias("event_recall_mean"),
    )


def missing_runs(results: DataFrame, seeds: int) -> DataFrame:
    """(model, label_frac, seed) combinations that have no run."""
    have = results.select("model", "label_frac", "seed")
    # a few names and a few fractions: one grouped row holds both lists
    lists = have.agg(F.collect_set("model").alias("m"), F.collect_set("label_frac").alias("f"))
    want = lists.select(F.explode("m").alias("model"), "f").select("model", F.explode("f").alias("label_frac"))
    want = want.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    return want.join(have, ["model", "label_frac", "seed"], "left_anti")


def compare_at(summary: DataFrame, frac: float, candidate: str, control: str) -> DataFrame:
    """Are the candidate's runs ahead of the control's at one label fraction?"""
    of = lambda m: F.max(F.when((F.col("label_frac") == frac) & (F.col("model") == m), F.col("mean")))
    g = summary.agg(of(candidate).alias("candidate"), of(control).alias("control"))
    verdict = (
        F.when(F.col("candidate").isNull() | F.col("control").isNull(), "MISSING")
        .when(F.col("candidate") > F.col("control"), "AHEAD")
        .otherwise("FAIL")
    )
    return g.withColumn("verdict", verdict)


def cleaning_gate(stats: DataFrame, ks: DataFrame) -> DataFrame:
    """Per mode: does cleaning change anything?

    ``stats``: cleaning_stats rows with a mode; ``ks``: (mode, statistic) rows.
    Passes on removal of 0.3 %, on removing mostly away from events, or on a
    shifted feature distribution.
    """
    total = F.greatest(F.col("removed"), F.lit(1))
    s = stats.select(
        "mode",
        "ticks_in",
        "removed",
        "removed_pct",
        (F.col("removed_in_pump") / total).alias("pump_frac"),
        (F.col("removed_in_normal") / total).alias("normal_frac"),
    )
    k = ks.groupBy("mode").agg(F.max("statistic").alias("ks"))
    s = s.join(k, "mode", "left")
    rate = F.col("removed_pct") >= 0.3
    apart = F.col("pump_frac") < F.col("normal_frac") * 0.5
    shift = F.coalesce(F.col("ks") > 0.05, F.lit(False))
    return s.select(
        "mode",
        "ticks_in",
        "removed",
        "removed_pct",
        F.round("pump_frac", 6).alias("pump_frac"),
        F.round("normal_frac", 6).alias("normal_frac"),
        F.round(F.col("pump_frac") / (F.col("normal_frac") + 1e-9), 6).alias("ratio"),
        F.round("ks", 6).alias("ks"),
        (rate | apart | shift).alias("passed"),
    )
