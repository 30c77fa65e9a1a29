"""Every tunable in one place. Durations are epoch milliseconds."""

from __future__ import annotations

from dataclasses import dataclass, replace

MINUTE = 60_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR

# The feature order every consumer relies on.
FEATURES = [
    "ret",
    "hl_range",
    "vwap_dev",
    "taker_buy_ratio",
    "log_vol",
    "log_ntr",
    "z_vol",
    "z_ntr",
    "z_ret",
    "roll_sigma",
]

MODES = ("none", "static", "adaptive")


@dataclass(frozen=True)
class Settings:
    # bars and features
    bar_ms: int = 5_000
    z_window: int = 720
    vol_window: int = 60
    vol_min: int = 10
    # windows and labels
    window_bars: int = 120
    stride_bars: int = 12
    late_bars: int = 24
    pre_ms: int = 60 * MINUTE
    during_ms: int = 5 * MINUTE
    buffer_ms: int = 3 * HOUR
    neg_ratio_train: float = 10.0
    neg_cap_eval: float = 50.0
    train_frac: float = 0.70
    val_frac: float = 0.15
    # cleaning
    static_pct: float = 0.02
    k0: float = 6.0
    sigma_window: int = 500
    sigma_min: int = 50
    clip_lo: float = 0.5
    clip_hi: float = 3.0
    min_chunk_trades: int = 1000
    min_clean_rows: int = 10
    # collection plan
    days_before: int = 3
    days_after: int = 1
    normal_days: int = 6
    # physical layout: how much of one pair's tape a single task may own
    tape_bucket_ms: int = HOUR
    tape_segment_rows: int = 2_000_000
    bar_segment_bars: int = 120_000
    seed: int = 42

    def __post_init__(self) -> None:
        if self.bar_ms <= 0 or DAY % self.bar_ms:
            raise ValueError("bar_ms must divide a day, or bars would straddle midnight")

    @property
    def z_min(self) -> int:
        return max(self.z_window // 4, 20)

    def with_(self, **kw) -> "Settings":
        return replace(self, **kw)


DEFAULT = Settings()

# The test tables hold one trade every few minutes per pair, so the same
# operators run on them with coarser bars (see FIXTURES.md, part 3).
FIXTURE = Settings(
    bar_ms=15 * MINUTE,
    z_window=96,
    vol_window=12,
    vol_min=10,
    window_bars=24,
    stride_bars=4,
    late_bars=5,
    pre_ms=3 * HOUR,
    during_ms=HOUR,
    buffer_ms=9 * HOUR,
    neg_ratio_train=10.0,
    sigma_window=100,
    sigma_min=20,
    min_chunk_trades=30,
    tape_bucket_ms=HOUR,
)
