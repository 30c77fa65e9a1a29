"""Rule search, class weights and batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.ranking import attach
from .measures import rule_score

# Limits tried for both surges.
GRID_FIRST, GRID_STEP, GRID_SIZE = 0.5, 0.25, 31


def _passed(x: str) -> Column:
    """How many grid limits lie strictly below the value."""
    n = F.ceil((F.col(x) - GRID_FIRST) / GRID_STEP)
    return F.least(F.greatest(n, F.lit(0)), F.lit(GRID_SIZE)).cast("int")


def rule_grid(win: DataFrame) -> DataFrame:
    """F1 of every limit pair (a, b): alert if max z_ret > a and max z_vol > b.

    A window passes limit pair (i, j) when it passed more than i and more than
    j limits. Windows are counted once per cell, map-side; the 32 x 32 cells
    are then summed along one limit and the result along the other.
    """
    size = F.lit(GRID_SIZE - 1)
    cells = win.groupBy(_passed("max_z_ret").alias("ia"), _passed("max_z_vol").alias("ib")).agg(
        F.sum("y").cast("bigint").alias("p"), F.count(F.lit(1)).alias("n")
    )
    count = lambda c, hit: F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(c)
    one = cells.withColumn("i", F.explode(F.sequence(F.lit(0), size))).groupBy("i", "ib").agg(
        F.sum("p").alias("all"), *[count(c, F.col("ia") > F.col("i")) for c in ("p", "n")]
    )
    g = one.withColumn("j", F.explode(F.sequence(F.lit(0), size))).groupBy("i", "j").agg(
        F.sum("all").alias("all"), *[count(c, F.col("ib") > F.col("j")) for c in ("p", "n")]
    )
    g = g.select("i", "j", F.col("p").alias("tp"), (F.col("n") - F.col("p")).alias("fp"), (F.col("all") - F.col("p")).alias("fn"))
    f1 = 2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1))
    limit = lambda k: F.lit(GRID_FIRST) + F.col(k) * GRID_STEP
    return g.select(limit("i").alias("a"), limit("j").alias("b"), "tp", "fp", "fn", f1.alias("f1"))


def fit_rule(win: DataFrame) -> DataFrame:
    """The best limit pair: one row (a, b, f1), smallest a then b on ties."""
    best = F.min_by(F.struct("a", "b", "f1"), F.struct(-F.round("f1", 12), F.col("a"), F.col("b")))
    return rule_grid(win).agg(best.alias("m")).select("m.a", "m.b", "m.f1")


def with_rule_score(win: DataFrame, rule: DataFrame) -> DataFrame:
    w = attach(win, rule.select("a", "b"), [], ["pair", "end_ms"])
    return w.withColumn("rule", rule_score(F.col("a"), F.col("b"))).drop("a", "b")


def class_weights(win: DataFrame) -> DataFrame:
    """Per class: n / (2 n_class); and negatives per positive."""
    c = win.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    both = W.partitionBy(F.lit(0))
    neg = F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).over(both)
    pos = F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).over(both)
    return c.select(
        "y",
        "n",
        (F.sum("n").over(both) / (2 * F.col("n"))).alias("weight"),
        (neg / F.greatest(pos, F.lit(1))).alias("pos_weight"),
    )


def with_weight(win: DataFrame) -> DataFrame:
    w = class_weights(win)
    return attach(win, w.select("y", "weight"), ["y"], ["pair", "end_ms"])


def score_separation(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean score of positives and negatives of each run, and whether they part the right way."""
    return scored.groupBy(*(by or [])).agg(
        F.avg(F.when(F.col("y") == 1, F.col("score"))).alias("pos_mean"),
        F.avg(F.when(F.col("y") == 0, F.col("score"))).alias("neg_mean"),
    ).withColumn("separates", F.col("pos_mean") > F.col("neg_mean"))


def score_windows(win: DataFrame, columns: list[str], fn: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Apply a user model to Arrow batches of windows; adds ``score``."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in win.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(score=fn(b[columns]).astype("float64"))

    return win.mapInPandas(run, schema=f"{fields}, score double")
