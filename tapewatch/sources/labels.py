"""Reading and normalising event labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

LABEL_SCHEMA = "pair string, symbol string, grp string, pump_time timestamp, source string"

# Spellings of date and hour met in the feeds.
TIME_FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd HH:mm",
    "yyyy-MM-dd H:mm",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd h:mm a",
    "yyyy-MM-dd",
    "dd MMM yyyy HH:mm",
    "d MMM yyyy HH:mm",
    "d.M.yyyy H:mm",
]


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header; adds pump_ms (epoch milliseconds)."""
    df = spark.read.schema(LABEL_SCHEMA).option("header", "true").option("enforceSchema", "true").csv(path)
    return df.withColumn("pump_ms", F.unix_millis("pump_time"))


def normalize_labels(feed: DataFrame, quote: str = "BTC", source: str = "feed", exchange: str = "binance") -> DataFrame:
    """One exchange's rows of a raw feed as labels, exact repeats removed.

    Of rows with the same pair and time the first group by name stays. Times
    are UTC, whatever the session's zone is. A time in no known spelling stops
    the job: as null it would merge with the pair's other unknown ones.
    """
    feed = feed.toDF(*[c.strip().lower() for c in feed.columns])
    text = F.trim(F.concat_ws(" ", F.trim("date"), F.trim("hour")))
    # the parser reads in the session's zone; the text of the parsed local time does not depend on it
    local = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS]).cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), local)
    at = F.coalesce((micros / 1000).cast("bigint"), F.raise_error(F.concat(F.lit("unknown date: "), text)).cast("bigint"))
    rows = feed.filter(F.lower("exchange") == exchange.lower()).select(
        F.concat(F.upper("symbol"), F.lit(quote.upper())).alias("pair"),
        "symbol",
        F.col("group").alias("grp"),
        at.alias("pump_ms"),
        F.lit(source).alias("source"),
    )
    # copies collapse map-side, however often one event is repeated
    first = F.min(F.struct("grp", "symbol", "source")).alias("r")
    return rows.groupBy("pair", "pump_ms").agg(first).select("pair", "r.symbol", "r.grp", "pump_ms", "r.source")
