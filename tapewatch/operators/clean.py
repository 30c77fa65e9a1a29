"""Tape cleaning: deduplication and removal of price spikes that revert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import DAY, DEFAULT, MODES, Settings
from ..functions.keys import day_of, floor_to
from ..functions.ranking import attach, exact_quantiles
from ..functions.rolling import sliding_moments
from ..session import staged

SEG = ["pair", "chunk_id", "seg"]
CHUNK = ["pair", "chunk_id"]


def dedup_trades(trades: DataFrame) -> DataFrame:
    """One row per (pair, agg_id), the earliest, with its number of ``copies``.

    A hash aggregate, so that copies collapse before the shuffle however many
    one id has. Copies of one id at one time are the same record.
    """
    return trades.groupBy("pair", "agg_id").agg(
        F.min("time").alias("time"),
        F.min_by("price", "time").alias("price"),
        F.min_by("qty", "time").alias("qty"),
        F.min_by("is_buyer_maker", "time").alias("is_buyer_maker"),
        F.count(F.lit(1)).alias("copies"),
    )


# ------------------------------------------------------------------ chunks
def day_summary(trades: DataFrame) -> DataFrame:
    """Trades per (pair, day): one row per file of the tape."""
    return trades.groupBy("pair", day_of("time").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def chunk_map(days: DataFrame) -> DataFrame:
    """Number runs of adjacent days: adds chunk_id and the chunk's trade count.

    Works on one row per pair-day, so the window is bounded by the calendar.
    """
    by_day = W.partitionBy("pair").orderBy("day")
    gap = F.col("day") - F.lag("day").over(by_day)
    days = days.withColumn("__new", F.when(gap == 1, 0).otherwise(1))
    days = days.withColumn("chunk_id", F.sum("__new").over(by_day).cast("int") - 1)
    return days.withColumn("chunk_trades", F.sum("n").over(W.partitionBy(*CHUNK))).drop("__new")


def filter_active(chunks: DataFrame, min_trades: int) -> DataFrame:
    return chunks.filter(F.col("chunk_trades") >= min_trades)


# ------------------------------------------------------------- predicates
def log_return(price: Column, previous: Column) -> Column:
    floor = F.lit(1e-12)
    return F.when(previous.isNotNull(), F.log(F.greatest(price, floor)) - F.log(F.greatest(previous, floor)))


def is_reverting_spike(ret: Column, following: Column, limit: Column) -> Column:
    """A move beyond ``limit`` of which the next trade undoes at least 70 %."""
    back = F.abs(ret + F.coalesce(following, F.lit(0.0))) < 0.3 * F.abs(ret)
    return F.coalesce((F.abs(ret) > limit) & back, F.lit(False))


# ---------------------------------------------------------------- segments
SKETCH = 8192  # of order keys: bounds are off by less than a thousandth of a bucket's trades


def _order_key(cfg: Settings) -> Column:
    """(time, agg_id) inside a bucket as one bigint that never decreases along it.

    ``__lo`` is the bucket's least id and ``__bits`` the length of its range of
    ids. Ids take the bits that times leave; a wider range loses low bits, so
    that some neighbours share a key.
    """
    room = 62 - cfg.tape_bucket_ms.bit_length()
    return F.expr(
        f"shiftleft(time - bucket, least(__bits, {room})) + shiftright(agg_id - __lo, cast(greatest(__bits - {room}, 0) as int))"
    )


def _parted(trades: DataFrame, hot: DataFrame, cfg: Settings) -> DataFrame:
    """Trades with ``bucket`` and ``sub``: 0, or the part of a hot bucket, in time order."""
    t = attach(trades, hot, ["pair", "bucket"], ["time", "agg_id"], "left")
    sub = F.size(F.filter("__cuts", lambda c: c < F.col("__key"))).cast("bigint")
    t = t.withColumn("__key", F.when(F.col("__cuts").isNotNull(), _order_key(cfg)))
    return t.withColumn("sub", F.when(F.col("__cuts").isNull(), F.lit(0)).otherwise(sub)).drop("__key", "__cuts", "__lo", "__bits")


def tape_buckets(trades: DataFrame, cfg: Settings, size: int) -> tuple[DataFrame, DataFrame]:
    """Trades with ``bucket`` (an hour of a pair) and ``sub``, and the exact count of each (pair, bucket, sub).

    A bucket of more than ``size`` trades is cut into parts of about half of
    that: the bounds come from a mergeable sketch of its (time, id) order, so
    neither one hot hour nor one hot millisecond stays whole.
    """
    trades = trades.withColumn("bucket", floor_to("time", cfg.tape_bucket_ms))
    n = F.count(F.lit(1)).alias("n")
    hours = staged(trades.groupBy("pair", "bucket").agg(n, F.min("agg_id").alias("__lo"), F.max("agg_id").alias("__hi")), "hours")
    hot = hours.filter(F.col("n") > size)
    if hot.isEmpty():
        return trades.withColumn("sub", F.lit(0).cast("bigint")), hours.select("pair", "bucket", F.lit(0).cast("bigint").alias("sub"), "n")
    hot = hot.select("pair", "bucket", "n", "__lo", F.length(F.bin(F.col("__hi") - F.col("__lo"))).alias("__bits"))
    keyed = attach(trades, hot.drop("n"), ["pair", "bucket"], ["time", "agg_id"])
    sketch = keyed.groupBy("pair", "bucket").agg(F.kll_sketch_agg_bigint(_order_key(cfg), F.lit(SKETCH)).alias("__s"))
    # as many parts as the hottest one needs, at most what the sketch can tell apart
    parts = min(SKETCH // 2, int(hot.agg(F.max(F.ceil(2 * F.col("n") / size))).first()[0]))
    ranks = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    cuts = F.array_distinct(F.kll_sketch_get_quantile_bigint("__s", ranks))
    hot = staged(hot.join(sketch, ["pair", "bucket"]).select("pair", "bucket", "__lo", "__bits", cuts.alias("__cuts")), "hot-hours")
    trades = _parted(trades, hot, cfg)
    cold = hours.join(hot, ["pair", "bucket"], "left_anti").select("pair", "bucket", F.lit(0).cast("bigint").alias("sub"), "n")
    counted = trades.groupBy("pair", "bucket", "sub").agg(n)
    return trades, staged(cold.unionByName(counted.join(hot, ["pair", "bucket"], "left_semi")), "parts")


def tape_segments(buckets: DataFrame, cfg: Settings, lookback: int, days: DataFrame | None = None) -> DataFrame:
    """Place each part of the tape in segments of about equal size.

    ``buckets`` has a row (pair, bucket, sub, n) for each part. One row for
    each: its chunk, the number of the chunk's trades before it, and the
    segments that need it: its own, the later ones whose first ``lookback``
    predecessors it holds, and the earlier one that looks ahead into it.
    """
    size = segment_rows(cfg, lookback)
    b = buckets.withColumn("day", day_of("bucket"))
    if days is None:
        days = chunk_map(b.groupBy("pair", "day").agg(F.sum("n").alias("n")))
    b = b.join(days.select("pair", "day", "chunk_id"), ["pair", "day"])
    run = W.partitionBy(*CHUNK).orderBy("bucket", "sub")
    b = b.withColumns(
        {
            "base": F.coalesce(F.sum("n").over(run.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
            "chunk_n": F.sum("n").over(W.partitionBy(*CHUNK)),
        }
    )
    b = b.withColumn("own", F.floor(F.col("base") / size))
    b = b.withColumn("__prev", F.lag("own").over(run))
    end = F.col("base") + F.col("n")
    first = F.greatest(F.col("own") + 1, F.floor(end / size))
    last = F.when(end < F.col("chunk_n"), F.floor((end + lookback - 1) / size))
    later = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    ahead = F.when(F.col("__prev") < F.col("own"), F.array("__prev")).otherwise(F.array().cast("array<bigint>"))
    return b.select(
        "pair", "bucket", "sub", "chunk_id", "base", "chunk_n", "own", F.concat(F.array("own"), later, ahead).alias("segs")
    )


def segment_rows(cfg: Settings, lookback: int) -> int:
    return max(cfg.tape_segment_rows, lookback, 1)


def _cut(trades: DataFrame, cfg: Settings, lookback: int, days: DataFrame | None) -> DataFrame:
    """Trades of each segment with their neighbours; adds ``g``, the rank in the chunk."""
    t, buckets = tape_buckets(trades, cfg, segment_rows(cfg, lookback))
    place = tape_segments(buckets, cfg, lookback, days)
    t = t.join(place, ["pair", "bucket", "sub"])
    t = t.withColumn("seg", F.explode("segs")).drop("segs", "bucket", "sub")
    order = W.partitionBy(*SEG).orderBy("time", "agg_id")
    t = t.withColumns(
        {
            "rn": F.row_number().over(order) - 1,
            "__start": F.first("base").over(order.rowsBetween(W.unboundedPreceding, 0)),
            "__before": F.lag("price").over(order),
            "__after": F.lead("price").over(order),
        }
    )
    t = t.withColumn("g", F.col("__start") + F.col("rn"))
    t = t.withColumn("ret", F.when(F.col("g") == 0, 0.0).otherwise(log_return(F.col("price"), F.col("__before"))))
    t = t.withColumn(
        "next_ret", F.when(F.col("__after").isNull(), 0.0).otherwise(log_return(F.col("__after"), F.col("price")))
    )
    return t.drop("base", "__start", "__before", "__after")


def trade_returns(trades: DataFrame, cfg: Settings = DEFAULT, days: DataFrame | None = None) -> DataFrame:
    """Trades with their log-return and the next one's, per chunk."""
    return _cut(trades, cfg, 1, days).filter(F.col("seg") == F.col("own")).drop("seg", "own", "rn")


def trade_sigma(trades: DataFrame, cfg: Settings = DEFAULT, days: DataFrame | None = None) -> DataFrame:
    """Adds ``raw_sigma``, the sample deviation of the last returns (null until enough)."""
    t = _cut(trades, cfg, cfg.sigma_window, days)
    t = sliding_moments(t, SEG, "rn", ["ret"], cfg.sigma_window)
    t = t.withColumn("raw_sigma", F.when(F.col("g") >= cfg.sigma_min - 1, F.col("ret__sd")))
    return t.filter(F.col("seg") == F.col("own")).drop("seg", "own", "rn", "ret__n", "ret__mean", "ret__sd")


def chunk_sigma(sigma: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Per chunk: the first deviation (it also stands for the trades before it) and the median."""
    s = sigma.filter(F.col("raw_sigma").isNotNull()).select(*CHUNK, "g", "raw_sigma")
    s = s.withColumns(
        {
            "floored": F.greatest("raw_sigma", F.lit(1e-8)),
            "__w": F.when(F.col("g") == cfg.sigma_min - 1, cfg.sigma_min).otherwise(1),
        }
    )
    first = s.filter(F.col("g") == cfg.sigma_min - 1).select(*CHUNK, F.col("raw_sigma").alias("first_sigma"))
    return exact_quantiles(s, CHUNK, "floored", {"median_sigma": 0.5}, "__w").join(first, CHUNK)


def regime(sigma: Column, median: Column, cfg: Settings) -> Column:
    r = sigma / F.greatest(median, F.lit(1e-9))
    return F.least(F.greatest(r, F.lit(cfg.clip_lo)), F.lit(cfg.clip_hi))


# ---------------------------------------------------------------- cleaning
KEEP = ["pair", "chunk_id", "agg_id", "time", "price", "qty", "is_buyer_maker"]


def flag_modes(
    trades: DataFrame, modes: Sequence[str] = MODES, cfg: Settings = DEFAULT, days: DataFrame | None = None
) -> DataFrame:
    """Deduplicated trades with ``chunk_id``, ``copies`` and a column ``removed_<mode>`` for each mode.

    All modes are judged in one pass over one segment frame. The deduplicated
    tape is stored first, since its counts and its rows are both needed; with
    ``adaptive`` the rows with their deviations are stored as well, for the
    chunk's median and the final test. ``adaptive`` uses the whole chunk's
    median and fills leading deviations backwards, so it belongs to batch work.
    """
    for m in modes:
        if m not in MODES:
            raise ValueError(f"unknown cleaning mode: {m}")
    t = dedup_trades(trades)
    if set(modes) == {"none"}:
        days = chunk_map(day_summary(trades)) if days is None else days
        t = t.withColumn("day", day_of("time")).join(days.select("pair", "day", "chunk_id"), ["pair", "day"])
        return t.select(*KEEP, "copies", F.lit(False).alias("removed_none"))
    t = staged(t, "tape")
    adaptive = "adaptive" in modes
    t = trade_sigma(t, cfg, days) if adaptive else trade_returns(t, cfg, days)
    flags = {"none": F.lit(False), "static": F.lit(cfg.static_pct)}
    if adaptive:
        t = staged(t, "sigma")
        t = _by_chunk_hour(t, chunk_sigma(t, cfg), cfg)
        sigma = F.coalesce("raw_sigma", "first_sigma")
        # no deviation at all in a chunk: no limit, nothing goes
        sigma = F.when(sigma.isNotNull(), F.greatest(sigma, F.lit(1e-8)))
        flags["adaptive"] = cfg.k0 * sigma * regime(sigma, F.col("median_sigma"), cfg)
    enough = F.col("chunk_n") >= cfg.min_clean_rows
    for m in set(modes) - {"none"}:
        flags[m] = is_reverting_spike(F.col("ret"), F.col("next_ret"), flags[m]) & enough
    return t.select(*KEEP, "copies", *[flags[m].alias(f"removed_{m}") for m in modes])


def flag_trades(
    trades: DataFrame, mode: str = "adaptive", cfg: Settings = DEFAULT, days: DataFrame | None = None
) -> DataFrame:
    """Deduplicated trades with ``chunk_id`` and ``removed`` of one mode."""
    t = flag_modes(trades, [mode], cfg, days)
    return t.select(*KEEP, F.col(f"removed_{mode}").alias("removed"))


def _by_chunk_hour(t: DataFrame, per: DataFrame, cfg: Settings) -> DataFrame:
    """Left join of chunk-level values, salted so that a hot chunk spreads."""
    return attach(t, per, CHUNK, ["time"], "left")


def clean_trades(
    trades: DataFrame, mode: str = "adaptive", cfg: Settings = DEFAULT, days: DataFrame | None = None
) -> DataFrame:
    return flag_trades(trades, mode, cfg, days).filter(~F.col("removed")).drop("removed")


def by_mode(flagged: DataFrame, modes: Sequence[str] = MODES) -> DataFrame:
    """The trades each mode keeps, told apart by ``mode``."""
    kept = F.filter(F.array(*[F.when(~F.col(f"removed_{m}"), F.lit(m)) for m in modes]), lambda m: m.isNotNull())
    return flagged.select(*KEEP, F.explode(kept).alias("mode"))


def cleaning_stats(flagged: DataFrame, labels: DataFrame, cfg: Settings = DEFAULT, modes: Sequence[str] = MODES) -> DataFrame:
    """One row a mode: trades in and out, removed, and where the removed ones lay.

    ``flagged`` comes from :func:`flag_modes`; its trades are counted with
    their copies. A duplicate counts as removed but is in neither bucket,
    because its id survives in the cleaned tape.
    """
    from .windows import near_label

    near = near_label(flagged, labels, "time", cfg)
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    aggs = [F.coalesce(F.sum("copies"), F.lit(0)).alias("ticks_in")]
    for m in modes:
        bad = F.col(f"removed_{m}")
        aggs += [
            F.struct(
                F.lit(m).alias("mode"), count(~bad).alias("ticks_out"), count(bad & F.col("near")).alias("removed_in_pump"),
                count(bad & ~F.col("near")).alias("removed_in_normal"),
            ).alias(f"__{m}")
        ]
    one = near.agg(*aggs).select("ticks_in", F.inline(F.array(*[F.col(f"__{m}") for m in modes])))
    gone = F.col("ticks_in") - F.col("ticks_out")
    return one.select(
        "mode",
        "ticks_in",
        "ticks_out",
        gone.alias("removed"),
        "removed_in_pump",
        "removed_in_normal",
        F.round(100.0 * gone / F.greatest("ticks_in", F.lit(1)), 4).alias("removed_pct"),
    )


def removed_trades(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """Raw trades whose id is not in the cleaned tape."""
    return raw.join(kept.select("pair", "agg_id"), ["pair", "agg_id"], "left_anti")
