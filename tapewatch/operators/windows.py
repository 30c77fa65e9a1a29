"""Strided windows, their labels, splits and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import DEFAULT, FEATURES, Settings
from ..functions.keys import day_of, draw_key, floor_to, key_bucket
from ..functions.ranking import attach, smallest_keys
from .measures import SEG, pane_of, window_ends


def strided_windows(feats: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """End bars of the windows: the T-th bar of a chunk and every stride after it."""
    f = feats.filter(F.col("own")) if "own" in feats.columns else feats
    return window_ends(f, cfg).select("pair", "chunk_id", F.col("idx").alias("end_idx"), F.col("bar_ms").alias("end_ms"))


def window_tensor(feats: DataFrame, cfg: Settings = DEFAULT, kept: DataFrame | None = None) -> DataFrame:
    """Each window as array<array<float>> of shape T x features.

    With ``kept`` (pair, end_ms) only those windows are put together: their
    bars are found by pane and joined, and other bars never form an array.
    """
    T, stride = cfg.window_bars, cfg.stride_bars
    f = feats.filter(F.col("own")) if "own" in feats.columns else feats
    if kept is None:
        kept = strided_windows(feats, cfg)
    row = F.struct("idx", F.array(*[F.col(x).cast("float") for x in FEATURES]).alias("x"))
    panes = f.select(*["pair", "chunk_id"], pane_of(F.col("idx"), cfg).alias("pane"), row.alias("r"))
    panes = panes.groupBy("pair", "chunk_id", "pane").agg(F.collect_list("r").alias("rows"))
    first, last = pane_of(F.col("end_idx") - (T - 1), cfg), pane_of(F.col("end_idx"), cfg)
    need = kept.select("pair", "chunk_id", "end_idx", "end_ms").withColumn("pane", F.explode(F.sequence(first, last)))
    parts = need.join(panes, ["pair", "chunk_id", "pane"])
    parts = parts.groupBy("pair", "chunk_id", "end_idx", "end_ms").agg(F.collect_list("rows").alias("p"))
    rows = F.array_sort(F.flatten("p"))
    rows = F.filter(rows, lambda r: r["idx"] > F.col("end_idx") - T)
    return parts.select("pair", "chunk_id", "end_ms", F.transform(rows, lambda r: r["x"]).alias("x"))


# ------------------------------------------------------------------ labels
def label_buckets(labels: DataFrame, before: int, after: int, width: int) -> DataFrame:
    """Per (pair, time bucket): the labels whose [t-before, t+after] touches it.

    An interval join keyed by the pair alone is one task for a hot pair. With
    the bucket in the key it spreads, meets at most one row per window, and
    still becomes a broadcast when the labels are few.
    """
    spans = labels.select(
        "pair",
        "pump_ms",
        F.explode(
            F.sequence(floor_to(F.col("pump_ms") - before, width), floor_to(F.col("pump_ms") + after, width), F.lit(width))
        ).alias("bucket"),
    )
    return spans.groupBy("pair", "bucket").agg(F.collect_set("pump_ms").alias("pumps"))


def _near(at: Column, before: int, after: int) -> Column:
    hit = F.exists("pumps", lambda t: (at >= t - before) & (at <= t + after))
    return F.coalesce(hit, F.lit(False))


def label_windows(win: DataFrame, labels: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Adds ``y`` and ``mask`` (near an event but not positive)."""
    before, after = max(cfg.pre_ms, cfg.buffer_ms), max(cfg.during_ms, cfg.buffer_ms)
    width = before + after
    lab = label_buckets(labels, before, after, width)
    out = win.withColumn("bucket", floor_to("end_ms", width)).join(lab, ["pair", "bucket"], "left")
    pos = _near(F.col("end_ms"), cfg.pre_ms, cfg.during_ms)
    buf = _near(F.col("end_ms"), cfg.buffer_ms, cfg.buffer_ms)
    return out.withColumns({"y": pos.cast("int"), "mask": buf & ~pos}).drop("bucket", "pumps")


def near_label(df: DataFrame, labels: DataFrame, time: str, cfg: Settings = DEFAULT) -> DataFrame:
    """Adds ``near``: inside [t-pre, t+during] of a label of the pair."""
    # an hour bounds what one (pair, bucket) can hold of a busy tape
    width = 3_600_000
    lab = label_buckets(labels, cfg.pre_ms, cfg.during_ms, width)
    out = df.withColumn("bucket", floor_to(time, width)).join(lab, ["pair", "bucket"], "left")
    return out.withColumn("near", _near(F.col(time), cfg.pre_ms, cfg.during_ms)).drop("bucket", "pumps")


# ------------------------------------------------------------------ splits
def split_bounds(labels: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """One row: t1, t2, the label-time quantiles that part train, val and test."""
    q = F.percentile("pump_ms", F.array(F.lit(cfg.train_frac), F.lit(cfg.train_frac + cfg.val_frac)))
    return labels.agg(q.alias("q")).select(F.col("q")[0].alias("t1"), F.col("q")[1].alias("t2"))


def assign_split(win: DataFrame, bounds: DataFrame) -> DataFrame:
    w = attach(win, bounds, [], ["pair", "end_ms"])
    split = F.when(F.col("end_ms") <= F.col("t1"), "train").when(F.col("end_ms") <= F.col("t2"), "val")
    return w.withColumn("split", split.otherwise("test")).drop("t1", "t2")


def subsample_negatives(win: DataFrame, cfg: Settings = DEFAULT, by: Sequence[str] = ()) -> DataFrame:
    """All positives and, per split (and ``by``), the first ratio x positives negatives by draw.

    The draw is a hash of the window's identity, so it does not depend on the
    order rows arrive in. Only the draw's cut value is ranked for; the windows
    themselves, with all their columns, are filtered in place.
    """
    keys = [*by, "split"]
    ratio = F.when(F.col("split") == "train", F.lit(cfg.neg_ratio_train)).otherwise(F.lit(cfg.neg_cap_eval))
    caps = win.groupBy(*keys).agg(F.sum("y").alias("__pos"))
    caps = caps.select(*keys, F.floor(ratio * F.greatest("__pos", F.lit(1))).cast("bigint").alias("cap"))
    w = win.withColumn("__draw", draw_key(cfg.seed, "pair", "end_ms"))
    neg = attach(w.filter("y = 0").select(*keys, "__draw"), caps, keys, ["__draw"])
    kept = smallest_keys(neg, keys, key_bucket("__draw"), ["__draw"], "cap")
    cut = kept.groupBy(*keys).agg(F.max("__draw").alias("__cut"))
    w = attach(w, cut, keys, ["pair", "end_ms"], "left")
    return w.filter((F.col("y") == 1) | (F.col("__draw") <= F.col("__cut"))).drop("__draw", "__cut")


def fit_scaler(stats: DataFrame) -> DataFrame:
    """Rows (feature, mean, std) over every value of the kept train windows.

    A bar counts once per window that holds it. Built from each window's mean
    and deviation; the tensor is never expanded.
    """
    tr = stats.filter(F.col("split") == "train")
    pairs = F.array(
        *[F.struct(F.lit(x).alias("feature"), F.col(f"{x}_mean").alias("m"), F.col(f"{x}_std").alias("s")) for x in FEATURES]
    )
    long = tr.select(F.inline(pairs))
    return long.groupBy("feature").agg(
        F.avg("m").alias("mean"), (F.sqrt(F.avg(F.col("s") * F.col("s")) + F.var_pop("m")) + 1e-8).alias("std")
    )


def standardize(df: DataFrame, scaler: DataFrame, columns: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """(x - mean) / std with the ten-row scaler turned into one row."""
    one = scaler.groupBy().agg(
        *[F.max(F.when(F.col("feature") == x, F.col("mean"))).alias(f"__m_{x}") for x in columns],
        *[F.max(F.when(F.col("feature") == x, F.col("std"))).alias(f"__s_{x}") for x in columns],
    )
    out = attach(df, one, [], ["pair", "bar_ms" if "bar_ms" in df.columns else "end_ms"])
    out = out.withColumns({x: (F.col(x) - F.col(f"__m_{x}")) / F.col(f"__s_{x}") for x in columns})
    return out.drop(*[f"__{k}_{x}" for x in columns for k in "ms"])


def pretrain_pool(win: DataFrame) -> DataFrame:
    return win.filter((F.col("split") == "train") & (F.col("y") == 0))


def split_report(win: DataFrame) -> DataFrame:
    """Windows and positives per split; warns where a split has none."""
    pos = F.sum("y")
    return win.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        pos.cast("bigint").alias("pos"),
        F.round(100.0 * F.avg("y"), 2).alias("pct"),
        (pos == 0).alias("no_positives"),
    )


def straddling(win: DataFrame, bounds: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Windows per bound that begin before it and end after it."""
    start = F.col("end_ms") - (cfg.window_bars - 1) * cfg.bar_ms
    w = attach(win, bounds, [], ["pair", "end_ms"])
    inside = lambda t: F.sum(((start <= F.col(t)) & (F.col("end_ms") > F.col(t))).cast("bigint"))
    return w.agg(inside("t1").alias("over_t1"), inside("t2").alias("over_t2"))


# ------------------------------------------------------------------ events
def group_events(win: DataFrame, gap_ms: int, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``event_id``: positives of a pair closer than ``gap_ms`` share one; -1 for negatives.

    Sessions are cut inside (pair, day); the first positive of a day looks at
    the last one of the day before it through a per-day summary, and so do the
    running numbers. Ids follow (pair, time).
    """
    keys = list(by)
    pos = win.filter("y = 1").select(*keys, "pair", "end_ms").distinct().withColumn("day", day_of("end_ms"))
    per = pos.groupBy(*keys, "pair", "day").agg(F.max("end_ms").alias("__last"))
    per = per.withColumn("__carry", F.lag("__last").over(W.partitionBy(*keys, "pair").orderBy("day"))).drop("__last")
    inside = W.partitionBy(*keys, "pair", "day").orderBy("end_ms")
    pos = pos.withColumn("__lag", F.lag("end_ms").over(inside)).join(per, [*keys, "pair", "day"])
    gap = F.col("end_ms") - F.coalesce("__lag", "__carry")
    pos = pos.withColumn("__new", F.when(gap <= gap_ms, 0).otherwise(1))
    tot = pos.groupBy(*keys, "pair", "day").agg(F.sum("__new").alias("__n"))
    # one row per pair-day that has a positive: bounded by the labels
    run = W.partitionBy(*keys, F.lit(0)).orderBy("pair", "day").rowsBetween(W.unboundedPreceding, -1)
    tot = tot.select(*keys, "pair", "day", F.coalesce(F.sum("__n").over(run), F.lit(0)).alias("__base"))
    pos = pos.join(tot, [*keys, "pair", "day"])
    number = F.col("__base") + F.sum("__new").over(inside.rowsBetween(W.unboundedPreceding, 0)) - 1
    ids = pos.select(*keys, "pair", "end_ms", number.cast("bigint").alias("event_id"))
    out = win.join(ids, [*keys, "pair", "end_ms"], "left")
    return out.withColumn("event_id", F.when(F.col("y") == 1, F.col("event_id")).otherwise(F.lit(-1).cast("bigint")))


def subsample_runs(win: DataFrame, fracs: Sequence[float], seeds: Sequence[int], gap_ms: int) -> DataFrame:
    """Adds label_frac and seed: for each of them a share of the positive events,
    whole, and of the negatives. A share of 1 keeps everything.
    """
    runs = ["label_frac", "seed"]
    w = group_events(win, gap_ms)
    spec = F.array(
        *[F.struct(F.lit(float(f)).alias("label_frac"), F.lit(int(s)).alias("seed")) for f in fracs for s in seeds]
    )
    share = lambda n: n * F.col("label_frac")

    events = w.filter("y = 1").select("event_id").distinct().select("event_id", F.inline(spec))
    events = events.withColumn("__draw", draw_key(F.col("seed"), F.lit("e"), "event_id"))
    caps = events.groupBy(*runs).agg(F.count(F.lit(1)).alias("n"))
    caps = caps.select(*runs, F.greatest(F.rint(share(F.col("n"))), F.lit(1)).cast("bigint").alias("cap"))
    ev = smallest_keys(attach(events, caps, runs, ["event_id"]), runs, key_bucket("__draw"), ["__draw"], "cap")

    neg = w.filter("y = 0").select(*w.columns, F.inline(spec))
    neg = neg.withColumn("__draw", draw_key(F.col("seed"), F.lit("n"), "pair", "end_ms"))
    caps = neg.groupBy(*runs).agg(F.count(F.lit(1)).alias("n"))
    caps = caps.select(*runs, F.greatest(F.floor(share(F.col("n"))), F.lit(1)).cast("bigint").alias("cap"))
    cut = smallest_keys(
        attach(neg.select(*runs, "__draw"), caps, runs, ["__draw"]), runs, key_bucket("__draw"), ["__draw"], "cap"
    )
    cut = cut.groupBy(*runs).agg(F.max("__draw").alias("__cut"))
    neg = attach(neg, cut, runs, ["__draw"]).filter(F.col("__draw") <= F.col("__cut"))

    pos = w.filter("y = 1").join(ev.select("event_id", *runs), "event_id")
    cols = [*win.columns, *runs]
    return pos.select(*cols).unionByName(neg.select(*cols))


def subsample_events(win: DataFrame, frac: float, seed: int, gap_ms: int) -> DataFrame:
    """One share and seed of :func:`subsample_runs`."""
    if frac >= 1.0:
        return win
    return subsample_runs(win, [frac], [seed], gap_ms).drop("label_frac", "seed")
