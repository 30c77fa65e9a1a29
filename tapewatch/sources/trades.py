"""Reading trades: day files, exchange dumps and stream messages."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.keys import day_of

TRADE_SCHEMA = T.StructType(
    [
        T.StructField("agg_id", T.LongType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("qty", T.DoubleType()),
        T.StructField("time", T.LongType()),
        T.StructField("is_buyer_maker", T.BooleanType()),
    ]
)
# The dump's column order and the stream message's short names.
DUMP_COLUMNS = ["agg_id", "price", "qty", "first_id", "last_id", "time", "is_buyer_maker", "is_best_match"]
MESSAGE_SCHEMA = "s string, a bigint, p double, q double, T bigint, m boolean"
ENVELOPE_SCHEMA = "data struct<e:string,s:string,a:string,p:string,q:string,T:string,m:string>"
# Later epoch values are microseconds: as milliseconds they would be past the year 2286.
LATEST_MS = 10_000_000_000_000


DAY_FILE = r"([^/]+)/(\d{4}-\d{2}-\d{2})\.parquet$"


def _day_paths(root: str, pairs: Sequence[str] | None) -> list[str]:
    if pairs is None:
        return [f"{root}/*/*.parquet"]
    # names are not patterns
    return [f"{root}/{re.sub(r'([][*?{}])', chr(92) * 2 + '1', p)}/*.parquet" for p in pairs]


def _from_path(path: Column) -> list[Column]:
    day = F.to_date(F.regexp_extract(path, DAY_FILE, 2))
    return [F.regexp_extract(path, DAY_FILE, 1).alias("pair"), day.alias("file_day")]


def day_files(spark: SparkSession, root: str, pairs: Sequence[str] | None = None) -> DataFrame:
    """(pair, file_day, length) of the day files under ``root``, from the listing alone: no file is opened."""
    files = spark.read.format("binaryFile").load(_day_paths(root, pairs))
    return files.select(*_from_path(F.col("path")), "length")


def read_trades(spark: SparkSession, root: str, pairs: Sequence[str] | None = None) -> DataFrame:
    """Day files ``root/{PAIR}/{YYYY-MM-DD}.parquet``: pair and file_day from the path.

    With ``pairs`` only their folders are listed. Filters on pair and file_day
    name nothing but the path, so Spark leaves out the files that fail them.
    """
    df = spark.read.schema(TRADE_SCHEMA).parquet(*_day_paths(root, pairs))
    return df.select(*_from_path(F.col("_metadata.file_path")), "*")


def listed_days(files: DataFrame, trades: DataFrame) -> DataFrame:
    """(pair, day, n) of every listed file, those without rows included: days for chunking by file list."""
    day = F.datediff("file_day", F.lit("1970-01-01")).cast("int").alias("day")
    n = trades.groupBy("pair", "file_day").agg(F.count(F.lit(1)).alias("n"))
    have = files.select("pair", "file_day").distinct().join(n, ["pair", "file_day"], "left")
    return have.select("pair", day, F.coalesce("n", F.lit(0)).alias("n"))


def write_day_files(trades: DataFrame, root: str, empty: DataFrame | None = None) -> None:
    """One file ``root/{PAIR}/{YYYY-MM-DD}.parquet`` for each pair-day, replacing the one that is there.

    ``empty`` (pair, day number) names days to list without rows. Spark writes
    the files; the driver only moves them to their names.
    """
    spark = trades.sparkSession
    date = lambda day: F.date_format(F.date_from_unix_date(day), "yyyy-MM-dd")
    work = f"{root}/_{uuid.uuid4().hex}"
    t = trades.select("pair", date(day_of("time")).alias("day"), *[f.name for f in TRADE_SCHEMA.fields])
    t.repartition("pair", "day").write.partitionBy("pair", "day").parquet(f"{work}/days")
    spark.createDataFrame([], TRADE_SCHEMA).coalesce(1).write.parquet(f"{work}/empty")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(conf)

    def part(folder):
        return next(s.getPath() for s in fs.listStatus(path(folder) if isinstance(folder, str) else folder) if s.getPath().getName().startswith("part-"))

    def target(pair, day):
        fs.mkdirs(path(root, pair))
        out = path(path(root, pair), f"{day}.parquet")
        fs.delete(out, True)
        return out

    for p in fs.listStatus(path(f"{work}/days")):
        if p.isDirectory():
            pair = unquote(p.getPath().getName().split("=", 1)[1])
            for d in fs.listStatus(p.getPath()):
                fs.rename(part(d.getPath()), target(pair, d.getPath().getName().split("=", 1)[1]))
    for r in empty.select("pair", date(F.col("day")).alias("day")).collect() if empty is not None else []:
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, part(f"{work}/empty"), fs, target(r["pair"], r["day"]), False, conf)
    fs.delete(path(work), True)


def read_tape(spark: SparkSession, root: str) -> DataFrame:
    """The tape written by :func:`write_tape`; filters on pair and day prune folders."""
    return spark.read.parquet(root)


def write_tape(trades: DataFrame, root: str, files_per_day: int = 8) -> None:
    """Partitioned by pair and day. A busy day is spread over several writers."""
    t = trades.withColumn("day", day_of("time"))
    spread = F.pmod(F.xxhash64("agg_id"), F.lit(files_per_day))
    t.repartition("pair", "day", spread).write.partitionBy("pair", "day").parquet(root)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in DUMP_COLUMNS])
    return spark.read.schema(schema).csv(path)


def ingest_agg_trades(rows: DataFrame) -> DataFrame:
    """Text rows of a dump, header or not, to typed trades; incomplete rows go."""
    header = F.lower("agg_id").contains("agg") | F.lower("price").contains("price")
    time = F.col("time").try_cast("bigint")
    typed = rows.filter(~F.coalesce(header, F.lit(False))).select(
        F.col("agg_id").try_cast("bigint").alias("agg_id"),
        F.col("price").try_cast("double").alias("price"),
        F.col("qty").try_cast("double").alias("qty"),
        F.when(time > LATEST_MS, F.floor(time / 1000).cast("bigint")).otherwise(time).alias("time"),
        F.coalesce(F.lower("is_buyer_maker").isin("true", "1"), F.lit(False)).alias("is_buyer_maker"),
    )
    return typed.dropna()


# ---------------------------------------------------------------- messages
def decode_trades(messages: DataFrame) -> DataFrame:
    """JSON ``value`` to typed trades with event time ``ts``; batch or stream."""
    j = messages.select(F.from_json(F.col("value").cast("string"), MESSAGE_SCHEMA).alias("j")).select("j.*")
    return j.select(
        F.col("s").alias("pair"),
        F.col("a").alias("agg_id"),
        F.col("p").alias("price"),
        F.col("q").alias("qty"),
        F.col("T").alias("time"),
        F.col("m").alias("is_buyer_maker"),
        F.timestamp_millis("T").alias("ts"),
    )


def decode_envelope(messages: DataFrame) -> DataFrame:
    """Exchange envelopes to trades; other message kinds are dropped."""
    d = messages.select(F.from_json(F.col("value").cast("string"), ENVELOPE_SCHEMA).alias("j")).select("j.data.*")
    return d.filter(F.col("e") == "aggTrade").select(
        F.col("s").alias("pair"),
        F.col("a").cast("bigint").alias("agg_id"),
        F.col("p").cast("double").alias("price"),
        F.col("q").cast("double").alias("qty"),
        F.col("T").cast("bigint").alias("time"),
        F.col("m").cast("boolean").alias("is_buyer_maker"),
    )


def encode_trades(trades: DataFrame) -> DataFrame:
    """Trades to messages: key = pair, value = JSON with the short names."""
    names = {"s": "pair", "a": "agg_id", "p": "price", "q": "qty", "T": "time", "m": "is_buyer_maker"}
    value: Column = F.to_json(F.struct(*[F.col(c).alias(k) for k, c in names.items()]))
    return trades.select(F.col("pair").alias("key"), value.alias("value"))


