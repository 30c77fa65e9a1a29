"""The test tables seen as a trade tape, labels and feeds (FIXTURES.md, part 2).

Every frame is derived from ``events`` with built-in columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..config import DAY, MINUTE
from ..functions.keys import floor_to

# event times carry no zone; they are UTC, whatever the session's zone is
EPOCH_US = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
WEEK = 7 * 86_400_000  # weeks begin on Monday: the epoch was a Thursday


def events(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/events.parquet")


def trade_columns() -> list[Column]:
    """Trades of events. Two days after the 7th and one after the 18th stay empty, so each pair has three chunks."""
    day = F.dayofmonth("ts")
    shift = F.when(day >= 19, 3).when(day >= 8, 2).otherwise(0)
    return [
        F.col("event_type").alias("pair"),
        F.col("event_id").alias("agg_id"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("qty"),
        (F.floor(F.expr(EPOCH_US) / 1000) + shift * DAY).cast("bigint").alias("time"),
        (F.col("event_id") % 2 == 1).alias("is_buyer_maker"),
    ]


def trades(spark: SparkSession, root: str) -> DataFrame:
    """The whole tape."""
    return events(spark, root).select(*trade_columns())


def trades_dup(spark: SparkSession, root: str) -> DataFrame:
    """The tape with every fiftieth trade sent twice."""
    t = trades(spark, root)
    copies = F.when(F.col("agg_id") % 50 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return t.withColumn("__c", F.explode(copies)).drop("__c")


def pumps(spark: SparkSession, root: str) -> DataFrame:
    """Per pair and week, the trade with the highest price stands for an event."""
    t = trades(spark, root)
    best = F.max_by(F.struct("agg_id", "time"), F.struct(F.col("price"), -F.col("agg_id")))
    p = t.groupBy("pair", floor_to(F.col("time") + 3 * 86_400_000, WEEK).alias("week")).agg(best.alias("b"))
    return p.select(
        "pair",
        floor_to("b.time", MINUTE).alias("pump_ms"),
        F.concat(F.lit("g"), (F.col("b.agg_id") % 3).cast("string")).alias("grp"),
        F.lit("synthetic").alias("source"),
    )


def dump_rows(spark: SparkSession, root: str) -> DataFrame:
    """The tape as text columns: a header row, odd units, gaps."""
    t = trades(spark, root)
    rows = t.select(
        F.col("agg_id").cast("string").alias("agg_id"),
        F.when(F.col("agg_id") % 97 == 0, "").otherwise(F.col("price").cast("string")).alias("price"),
        F.col("qty").cast("string").alias("qty"),
        F.col("agg_id").cast("string").alias("first_id"),
        F.col("agg_id").cast("string").alias("last_id"),
        F.when(F.col("agg_id") % 2 == 0, F.col("time") * 1000).otherwise(F.col("time")).cast("string").alias("time"),
        F.when(F.col("is_buyer_maker"), "True").otherwise("False").alias("is_buyer_maker"),
        F.lit("True").alias("is_best_match"),
    )
    first = t.agg(F.min("agg_id").cast("string").alias("agg_id"))
    header = first.select(
        F.lit("agg_trade_id"), F.lit("price"), F.lit("quantity"), F.lit("first_trade_id"), F.lit("last_trade_id"),
        F.lit("transact_time"), F.lit("is_buyer_maker"), F.lit("is_best_match"),
    )
    return rows.unionAll(header)


def label_feed(spark: SparkSession, root: str) -> DataFrame:
    """Labels as a text feed: odd spelling, two time formats, other exchanges, repeats."""
    p = pumps(spark, root)
    n = F.row_number().over(W.partitionBy("pair").orderBy("pump_ms"))
    ts = F.expr("timestampadd(MILLISECOND, pump_ms, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    p = p.withColumn("n", n)
    feed = p.select(
        F.lower("pair").alias(" Symbol"),
        F.col("grp").alias("Group "),
        F.date_format(ts, "yyyy-MM-dd").alias("date"),
        F.when(F.col("n") % 2 == 0, F.date_format(ts, "HH:mm:ss")).otherwise(F.date_format(ts, "HH:mm")).alias("hour"),
        F.when(F.col("n") % 4 == 0, "other").otherwise("Binance").alias("Exchange"),
    )
    again = feed.filter("hour not like '%:%:%'").withColumn("Group ", F.lit("g9"))
    return feed.unionByName(again)


def near_labels(spark: SparkSession, root: str) -> DataFrame:
    """Each label announced again by other groups, 10 and 40 minutes later."""
    p = pumps(spark, root)
    later = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(g).alias("g")) for m, g in ((0, ""), (10, "x"), (40, "y"))])
    q = p.withColumn("e", F.explode(later))
    return q.select(
        "pair",
        (F.col("pump_ms") + F.col("e.m") * MINUTE).alias("pump_ms"),
        F.concat("grp", "e.g").alias("grp"),
        "source",
    )


def trade_json(spark: SparkSession, root: str) -> DataFrame:
    t = trades(spark, root)
    msg = F.struct(
        F.col("pair").alias("s"), F.col("agg_id").alias("a"), F.col("price").alias("p"),
        F.col("qty").alias("q"), F.col("time").alias("T"), F.col("is_buyer_maker").alias("m"),
    )
    return t.select(F.to_json(msg).alias("value"))


def envelope_json(spark: SparkSession, root: str) -> DataFrame:
    t = trades(spark, root)
    body = F.struct(
        F.when(F.col("agg_id") % 10 == 0, "ping").otherwise("aggTrade").alias("e"),
        F.col("pair").alias("s"),
        F.col("agg_id").alias("a"),
        F.col("price").cast("string").alias("p"),
        F.col("qty").cast("string").alias("q"),
        F.col("time").alias("T"),
        F.col("is_buyer_maker").alias("m"),
    )
    return t.select(F.to_json(F.struct(body.alias("data"))).alias("value"))

