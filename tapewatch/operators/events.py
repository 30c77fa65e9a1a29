"""Labelled events: collection plan, limits, merging and statistics.

Event tables hold announcements made by people; their windows per pair are
bounded by that, not by the tape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..config import DEFAULT, MINUTE, Settings
from ..functions.keys import day_of


def event_days(labels: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Every day from ``days_before`` ahead of an event to ``days_after`` past it."""
    d = day_of("pump_ms")
    days = F.explode(F.sequence(d - cfg.days_before, d + cfg.days_after)).alias("day")
    return labels.select("pair", days).distinct()


def normal_days(labels: DataFrame, cfg: Settings = DEFAULT, step: int = 7, reach: int = 180) -> DataFrame:
    """The first days, weekly back from a pair's first event, without an event."""
    first = labels.groupBy("pair").agg(day_of(F.min("pump_ms")).alias("d0"))
    cand = first.select("pair", "d0", F.explode(F.sequence(F.lit(step), F.lit(reach - 1), F.lit(step))).alias("back"))
    cand = cand.select("pair", "back", (F.col("d0") - F.col("back")).alias("day"))
    pumps = labels.select("pair", day_of("pump_ms").alias("day")).distinct()
    free = cand.join(pumps, ["pair", "day"], "left_anti")
    rank = F.row_number().over(W.partitionBy("pair").orderBy("back"))
    return free.withColumn("rn", rank).filter(F.col("rn") <= cfg.normal_days).select("pair", "day")


def pair_day_plan(labels: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    return event_days(labels, cfg).union(normal_days(labels, cfg)).distinct()


def plan_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("pair").agg(F.count(F.lit(1)).alias("days"))


def first_events(labels: DataFrame, n: int) -> DataFrame:
    return labels.orderBy("pump_ms", "pair").limit(n)


def first_pairs(labels: DataFrame, n: int) -> DataFrame:
    """Labels of the ``n`` pairs that appear first."""
    seen = labels.groupBy("pair").agg(F.min("pump_ms").alias("t")).orderBy("t", "pair").limit(n)
    return labels.join(seen, "pair", "left_semi")


def with_data(labels: DataFrame, days: DataFrame) -> DataFrame:
    """Labels of pairs that have a tape."""
    return labels.join(days.select("pair").distinct(), "pair", "left_semi")


def fuzzy_dedup(labels: DataFrame, minutes: int = 30) -> DataFrame:
    """Chain labels of a pair less than ``minutes`` apart; keep the earliest.

    The groups of a chain are joined with '|' in time order.
    """
    by = W.partitionBy("pair").orderBy("pump_ms", "grp")
    gap = F.col("pump_ms") - F.lag("pump_ms").over(by)
    new = F.when(gap < minutes * MINUTE, 0).otherwise(1)
    chained = labels.withColumn("__new", new).withColumn("chain", F.sum("__new").over(by))
    rows = F.array_sort(F.collect_list(F.struct("pump_ms", "grp", "source")))
    g = chained.groupBy("pair", "chain").agg(rows.alias("rows"))
    first = F.col("rows")[0]
    return g.select(
        "pair",
        first["pump_ms"].alias("pump_ms"),
        F.array_join(F.transform("rows", lambda r: r["grp"]), "|").alias("grp"),
        first["source"].alias("source"),
        F.size("rows").alias("merged"),
    )


def label_stats(labels: DataFrame) -> DataFrame:
    return labels.agg(
        F.count(F.lit(1)).alias("events"),
        F.countDistinct("pair").alias("pairs"),
        F.min("pump_ms").alias("first_ms"),
        F.max("pump_ms").alias("last_ms"),
    )


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Rows per value; with ``top`` only the most frequent, ties by value."""
    g = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("n"), column).limit(top) if top else g


def allow_pairs(df: DataFrame, pairs: list[str] | None, column: str = "pair") -> DataFrame:
    """Only listed pairs, or all when none are listed."""
    return df.filter(F.col(column).isin(list(pairs))) if pairs else df


def latest_per_key(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The newest ``n`` rows per key."""
    w = W.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")
