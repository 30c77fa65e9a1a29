"""Ten features per bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..config import DEFAULT, FEATURES, Settings
from ..functions.keys import finite_or_zero, positive_log, ratio
from ..functions.rolling import sliding_moments


def bar_features(bars: DataFrame, cfg: Settings = DEFAULT, method: str = "blocks") -> DataFrame:
    """Features of a gap-free grid; inf, NaN and warm-up values become 0.

    All frames share one partitioning and one sort. On segmented bars the
    repeated history gets values too; drop it with ``own``.
    """
    keys = [k for k in ("pair", "chunk_id", "seg") if k in bars.columns]
    order = W.partitionBy(*keys).orderBy("idx")
    c = F.col
    f = bars.withColumns({"__lc": positive_log("close")})
    f = f.withColumns(
        {
            "ret": c("__lc") - F.lag("__lc").over(order),
            "__row": F.row_number().over(order) - 1,
            "hl_range": ratio(c("high") - c("low"), c("close")),
            "vwap_dev": ratio(c("close") - c("vwap"), c("vwap")),
            "taker_buy_ratio": F.when(c("volume") > 0, ratio(c("taker_buy_vol"), c("volume"))).otherwise(0.5),
            "log_vol": F.log1p("volume"),
            "log_ntr": F.log1p(c("n_trades").cast("double")),
        }
    )
    f = sliding_moments(f, keys, "__row", ["ret"], cfg.vol_window, method)
    f = sliding_moments(f, keys, "__row", ["log_vol", "log_ntr"], cfg.z_window, method)

    def z(name):
        enough = c(f"{name}__n") >= cfg.z_min
        return F.when(enough, (c(name) - c(f"{name}__mean")) / (c(f"{name}__sd") + 1e-9))

    sigma = F.when(c("ret__n") >= cfg.vol_min, c("ret__sd"))
    f = f.withColumns({"z_vol": z("log_vol"), "z_ntr": z("log_ntr"), "roll_sigma": sigma})
    f = f.withColumn("z_ret", c("ret") / (c("roll_sigma") + 1e-9))
    extra = [k for k in ("own",) if k in bars.columns]
    return f.select(*keys, "idx", "bar_ms", *extra, *[finite_or_zero(x).alias(x) for x in FEATURES])
