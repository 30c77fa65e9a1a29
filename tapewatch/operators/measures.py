"""Aggregates over each window, by panes.

Consecutive windows share all but ``stride`` bars. Bars are first reduced to
panes of ``stride`` bars (a hash aggregate), then each window combines the few
panes it covers. When the window length is not a multiple of the stride, the
oldest pane contributes only its last bars, kept as a second set of columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import DEFAULT, FEATURES, Settings

SEG = ["pair", "chunk_id", "seg"]
MICRO = ["ofi", "ofi_max", "vpin", "vpin_late", "amihud", "amihud_max"]
STATS = [f"{x}_{s}" for s in ("mean", "std", "max", "min", "last") for x in FEATURES]


def _offset(cfg: Settings) -> int:
    return (-cfg.window_bars) % cfg.stride_bars


def pane_of(idx: Column, cfg: Settings) -> Column:
    return F.floor((idx + _offset(cfg)) / cfg.stride_bars)


def window_ends(df: DataFrame, cfg: Settings) -> DataFrame:
    T, stride = cfg.window_bars, cfg.stride_bars
    return df.filter((F.col("idx") >= T - 1) & (F.pmod(F.col("idx") - (T - 1), F.lit(stride)) == 0))


class _Panes:
    """Collects pane columns and the window expressions built on them."""

    def __init__(self, cfg: Settings):
        self.cfg = cfg
        self.pane: list[Column] = []
        self.late = divmod(cfg.late_bars, cfg.stride_bars)
        self.full = divmod(cfg.window_bars, cfg.stride_bars)

    def _add(self, fn, x: Column, name: str, tail: int) -> None:
        self.pane.append(fn(x).alias(name))
        if tail:
            newest = F.pmod(F.col("idx") + _offset(self.cfg), F.lit(self.cfg.stride_bars))
            self.pane.append(fn(F.when(newest >= self.cfg.stride_bars - tail, x)).alias(f"{name}__tail"))

    def _frame(self, panes: int):
        return W.partitionBy(*SEG).orderBy("pane").rowsBetween(-(panes - 1), 0)

    def _older(self, name: str, panes: int) -> Column:
        return F.lag(f"{name}__tail", panes).over(W.partitionBy(*SEG).orderBy("pane"))

    def _over(self, fn, merge, x: Column, name: str, extent: tuple[int, int]) -> Column:
        panes, tail = extent
        self._add(fn, x, name, tail)
        if not panes:
            raise ValueError("the window and its late part must cover a stride")
        main = fn(F.col(name)).over(self._frame(panes))
        return merge(main, self._older(name, panes)) if tail else main

    def total(self, x: Column, name: str, late: bool = False) -> Column:
        return self._over(F.sum, lambda a, b: a + F.coalesce(b, F.lit(0.0)), x, name, self.late if late else self.full)

    def peak(self, x: Column, name: str) -> Column:
        return self._over(F.max, F.greatest, x, name, self.full)

    def trough(self, x: Column, name: str) -> Column:
        return self._over(F.min, F.least, x, name, self.full)

    def moments(self, x: Column, name: str) -> tuple[Column, Column]:
        """Mean and population deviation; pane deviations are merged, not squares."""
        panes, tail = self.full
        s = self.cfg.stride_bars
        self._add(F.avg, x, f"{name}__m", tail)
        self._add(F.var_pop, x, f"{name}__v", tail)
        fr = self._frame(panes)
        mean, var = F.avg(f"{name}__m").over(fr), F.avg(f"{name}__v").over(fr) + F.var_pop(f"{name}__m").over(fr)
        if tail:
            n1, n2 = panes * s, tail
            m2, v2 = self._older(f"{name}__m", panes), self._older(f"{name}__v", panes)
            n = n1 + n2
            d = m2 - mean
            var = (var * n1 + v2 * n2 + d * d * (n1 * n2 / n)) / n
            mean = (mean * n1 + m2 * n2) / n
        return mean, F.sqrt(F.greatest(var, F.lit(0.0)))


def window_measures(
    feats: DataFrame, cfg: Settings = DEFAULT, stats: bool = True, micro: bool = True
) -> DataFrame:
    """Windows (pair, chunk_id, end_idx, end_ms) with their measures.

    ``stats``: mean, deviation, max, min and last of every feature.
    ``micro``: order-flow imbalance, toxicity and price impact, the largest
    z_ret and z_vol, and the rush-order score.
    ``feats`` must be segmented; runs without a further shuffle.
    """
    c = F.col
    p = _Panes(cfg)
    out: dict[str, Column] = {}
    if stats:
        for x in FEATURES:
            out[f"{x}_mean"], out[f"{x}_std"] = p.moments(c(x), x)
            out[f"{x}_max"] = p.peak(c(x), f"{x}__hi")
            out[f"{x}_min"] = p.trough(c(x), f"{x}__lo")
            p.pane.append(F.max_by(x, "idx").alias(f"{x}_last"))
            out[f"{x}_last"] = c(f"{x}_last")
    if micro:
        T = cfg.window_bars
        vol = F.expm1("log_vol")
        buy, sell = vol * c("taker_buy_ratio"), vol * (1.0 - c("taker_buy_ratio"))
        size = F.abs(c("ret"))
        v, r = p.total(vol, "__v"), p.total(size, "__r")
        b, s = p.total(buy, "__b"), p.total(sell, "__s")
        lb, ls = p.total(buy, "__lb", late=True), p.total(sell, "__ls", late=True)
        lv = p.total(vol, "__lv", late=True)
        out["ofi"] = b - s
        out["ofi_max"] = p.peak(buy - sell, "__d")
        out["vpin"] = F.abs(b - s) / (v + 1e-9)
        out["vpin_late"] = F.abs(lb - ls) / (lv + 1e-9)
        out["amihud"] = (r / T) / (v / T + 1e-9)
        out["amihud_max"] = p.peak(size, "__rx") / (v / T + 1e-9)
        out["max_z_ret"] = p.peak(c("z_ret"), "__zr")
        out["max_z_vol"] = p.peak(c("z_vol"), "__zv")
        rush = F.greatest(c("z_ntr"), F.lit(0.0)) * F.greatest(c("taker_buy_ratio") - 0.5, F.lit(0.0))
        out["rush_order"] = p.peak(rush, "__ro")
    panes = feats.groupBy(*SEG, pane_of(c("idx"), cfg).alias("pane")).agg(
        F.max("idx").alias("end_idx"), F.max("bar_ms").alias("end_ms"), F.max_by("own", "idx").alias("own"), *p.pane
    )
    win = panes.select("pair", "chunk_id", "end_idx", "end_ms", "own", *[e.alias(n) for n, e in out.items()])
    win = win.withColumn("idx", c("end_idx"))
    return window_ends(win.filter("own"), cfg).drop("own", "idx")


def rule_score(a: Column, b: Column) -> Column:
    """Margin by which both the return and the volume surge pass their limits."""
    return F.least(F.col("max_z_ret") - a, F.col("max_z_vol") - b)
