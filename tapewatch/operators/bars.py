"""Fixed-width OHLCV bars and the gap-free grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import DEFAULT, Settings
from ..functions.keys import day_of, floor_to, ratio, tape_order

CHUNK = ["pair", "chunk_id"]
SIZES = ["volume", "n_trades", "taker_buy_vol", "quote_vol"]


def bar_aggregates(time: Column, agg_id: Column, origin: Column, bar_ms: int, wide_ids: bool = False) -> list[Column]:
    """The bar's columns, for a batch or a streaming group alike."""
    order = tape_order(time, agg_id, origin, bar_ms, wide_ids)
    return [
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("qty").alias("volume"),
        F.count(F.lit(1)).alias("n_trades"),
        F.sum(F.when(~F.col("is_buyer_maker"), F.col("qty")).otherwise(0.0)).alias("taker_buy_vol"),
        F.sum(F.col("price") * F.col("qty")).alias("quote_vol"),
    ]


def trades_to_bars(trades: DataFrame, cfg: Settings = DEFAULT, wide_ids: bool = False) -> DataFrame:
    """Non-empty bars per (pair, bar_ms): partial and final hash aggregate."""
    t = trades.withColumn("bar_ms", floor_to("time", cfg.bar_ms))
    aggs = bar_aggregates(F.col("time"), F.col("agg_id"), F.col("bar_ms"), cfg.bar_ms, wide_ids)
    return t.groupBy("pair", "bar_ms").agg(*aggs)


def with_chunks(bars: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk of each bar. Joined to bars, which are far fewer than trades.

    Bars of a pair-day are bounded by the clock, so no key of this join is hot.
    """
    return bars.withColumn("day", day_of("bar_ms")).join(
        chunks.select("pair", "day", "chunk_id"), ["pair", "day"]
    )


def with_vwap(bars: DataFrame) -> DataFrame:
    v = F.coalesce(F.when(F.col("volume") > 0, ratio(F.col("quote_vol"), F.col("volume"))), F.col("close"))
    return bars.withColumn("vwap", v)


def _with_next(bars: DataFrame) -> DataFrame:
    """Adds next_ms, chunk_start and chunk_end.

    The following bar is looked up inside the day; the day's last bar takes the
    first bar of the next day from a frame with one row per pair-day.
    """
    day = F.col("day") if "day" in bars.columns else day_of("bar_ms")
    bars = bars.withColumn("day", day)
    per = bars.groupBy(*CHUNK, "day").agg(F.min("bar_ms").alias("__first"), F.max("bar_ms").alias("__last"))
    chunk = W.partitionBy(*CHUNK)
    per = per.select(
        *CHUNK,
        "day",
        F.lead("__first").over(chunk.orderBy("day")).alias("__carry"),
        F.min("__first").over(chunk).alias("chunk_start"),
        F.max("__last").over(chunk).alias("chunk_end"),
    )
    inside = W.partitionBy(*CHUNK, "day").orderBy("bar_ms")
    bars = bars.withColumn("__lead", F.lead("bar_ms").over(inside)).join(per, [*CHUNK, "day"])
    return bars.withColumn("next_ms", F.coalesce("__lead", "__carry")).drop("__lead", "__carry", "day")


def _densify(bars: DataFrame, lo: Column, hi: Column, bar_ms: int) -> DataFrame:
    """One row per grid slot idx in [lo, hi]; slots after the first carry the close."""
    bars = bars.withColumn("__i0", F.col("idx")).withColumn("idx", F.explode(F.sequence(lo, hi)))
    real = F.col("idx") == F.col("__i0")
    cols = {c: F.when(real, F.col(c)).otherwise(F.col("close")) for c in ("open", "high", "low")}
    cols |= {c: F.when(real, F.col(c)).otherwise(0).cast("bigint" if c == "n_trades" else "double") for c in SIZES}
    cols["bar_ms"] = F.col("chunk_start") + F.col("idx") * bar_ms
    return with_vwap(bars.withColumns(cols)).drop("__i0", "next_ms", "chunk_start", "chunk_end")


def _indexed(bars: DataFrame, bar_ms: int) -> DataFrame:
    b = _with_next(bars)
    at = lambda c: ((F.col(c) - F.col("chunk_start")) / bar_ms).cast("bigint")
    return b.withColumns({"idx": at("bar_ms"), "__until": F.coalesce(at("next_ms") - 1, at("bar_ms"))})


def fill_bar_gaps(bars: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Continuous grid from each chunk's first bar to its last.

    Every bar knows where the next one starts, so it fills the gap behind it;
    no grid is generated and joined. Serves tape bars and streamed bars alike.
    """
    b = _indexed(bars, cfg.bar_ms)
    return _densify(b, F.col("idx"), F.col("__until"), cfg.bar_ms).drop("__until")


def halo_bars(cfg: Settings) -> int:
    need = cfg.z_window + cfg.window_bars + cfg.vol_window
    return -(-need // cfg.stride_bars) * cfg.stride_bars


def segment_bars(bars: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """The gap-free grid cut into segments that each hold their own history.

    Adds ``seg`` and ``own``. A segment repeats the bars its rolling frames and
    windows look back on, so everything later runs inside it: one shuffle, of
    the non-empty bars, and no task larger than a segment. Segments start on
    window-stride boundaries.
    """
    stride = cfg.stride_bars
    size = max(cfg.bar_segment_bars // stride, 1) * stride
    halo = halo_bars(cfg)
    off = (-cfg.window_bars) % stride
    b = _indexed(bars, cfg.bar_ms)
    seg_of = lambda c: F.floor((c + off) / size)
    last = ((F.col("chunk_end") - F.col("chunk_start")) / cfg.bar_ms).cast("bigint")
    top = F.least(F.col("__until") + halo, last)
    b = b.withColumn("seg", F.explode(F.sequence(seg_of(F.col("idx")), seg_of(top))))
    b = b.repartition("pair", "chunk_id", "seg")
    start = F.col("seg") * size - off
    b = b.withColumns(
        {"__lo": F.greatest(F.col("idx"), start - halo), "__hi": F.least(F.col("__until"), start + size - 1)}
    )
    # only bars whose gap reaches into the segment or its history stay
    b = b.filter(F.col("__lo") <= F.col("__hi"))
    d = _densify(b, F.col("__lo"), F.col("__hi"), cfg.bar_ms)
    return d.withColumn("own", F.col("idx") >= F.col("seg") * size - off).drop("__lo", "__hi", "__until")


def close_bars(trades: DataFrame, width_ms: int, wide_ids: bool = False) -> DataFrame:
    """Last price per interval; empty intervals are absent."""
    t = trades.withColumn("bar_ms", floor_to("time", width_ms))
    order = tape_order("time", "agg_id", F.col("bar_ms"), width_ms, wide_ids)
    return t.groupBy("pair", "bar_ms").agg(F.max_by("price", order).alias("close"))


def chunk_report(chunks: DataFrame) -> DataFrame:
    """Chunks per pair: mean and maximum."""
    per = chunks.groupBy("pair").agg(F.countDistinct("chunk_id").alias("n"))
    return per.agg(
        F.count(F.lit(1)).alias("pairs"), F.round(F.avg("n"), 6).alias("mean_chunks"), F.max("n").alias("max_chunks")
    )
