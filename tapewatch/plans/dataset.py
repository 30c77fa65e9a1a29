"""From a raw tape and labels to labelled, split and sampled windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULT, Settings
from ..operators.bars import segment_bars, trades_to_bars, with_chunks
from ..operators.clean import by_mode, chunk_map, clean_trades, day_summary, dedup_trades, filter_active, flag_modes
from ..operators.features import bar_features
from ..operators.measures import window_measures
from ..operators.windows import assign_split, label_windows, split_bounds, subsample_negatives
from ..session import staged


def active_days(trades: DataFrame, cfg: Settings = DEFAULT, days: DataFrame | None = None) -> DataFrame:
    """Chunk of every day that belongs to a chunk with enough trades."""
    return filter_active(chunk_map(day_summary(trades) if days is None else days), cfg.min_chunk_trades)


def tape_bars(trades: DataFrame, cfg: Settings = DEFAULT, mode: str = "none", days: DataFrame | None = None) -> DataFrame:
    """Cleaned, non-empty bars with their chunk."""
    days = active_days(trades, cfg) if days is None else days
    kept = dedup_trades(trades) if mode == "none" else clean_trades(trades, mode, cfg, days)
    return with_chunks(trades_to_bars(kept, cfg), days)


def tape_features(trades: DataFrame, cfg: Settings = DEFAULT, mode: str = "none", days: DataFrame | None = None) -> DataFrame:
    """Features on the segmented grid (with each segment's history).

    The grid needs the bars and their first and last per day. Bars are a small
    part of the tape, so they are stored rather than built twice from it.
    """
    bars = staged(tape_bars(trades, cfg, mode, days), "bars")
    return bar_features(segment_bars(bars, cfg), cfg)


def windows_of(feats: DataFrame, labels: DataFrame, cfg: Settings = DEFAULT, stats: bool = True, micro: bool = True) -> DataFrame:
    """Unambiguous windows of a feature grid with measures, label and split, before sampling."""
    win = window_measures(feats, cfg, stats, micro)
    # labels without any tape still count for the split bounds
    lab = label_windows(win, labels, cfg).filter(~F.col("mask")).drop("mask")
    return assign_split(lab, split_bounds(labels, cfg))


def labelled_windows(
    trades: DataFrame, labels: DataFrame, cfg: Settings = DEFAULT, mode: str = "none", stats: bool = True, micro: bool = True
) -> DataFrame:
    """:func:`windows_of` the tape's features."""
    return windows_of(tape_features(trades, cfg, mode), labels, cfg, stats, micro)


def sampled_windows(feats: DataFrame, labels: DataFrame, cfg: Settings = DEFAULT, mode: str = "adaptive", stats: bool = True) -> DataFrame:
    """The sampled windows of a feature grid.

    Sampling reads the windows three times (positives per split, draws, rows).
    They are stored first, so the grid is worked through once.
    """
    return subsample_negatives(staged(windows_of(feats, labels, cfg, stats), "windows"), cfg).withColumn("mode", F.lit(mode))


def build_dataset(
    trades: DataFrame, labels: DataFrame, cfg: Settings = DEFAULT, mode: str = "adaptive", stats: bool = True
) -> DataFrame:
    """The sampled windows of one cleaning mode."""
    return sampled_windows(tape_features(trades, cfg, mode), labels, cfg, mode, stats)


# ---------------------------------------------------- several cleaning modes
# A mode's tape is told apart by its pair's name, so bars, grids, features and
# windows of all modes are worked out together and the tape is read once.
_SEP = "\x1f"


def _tagged(df: DataFrame, modes: Sequence[str]) -> DataFrame:
    tags = F.explode(F.array(*[F.lit(m) for m in modes]))
    return df.withColumn("__mode", tags).withColumn("pair", F.concat_ws(_SEP, "__mode", "pair")).drop("__mode")


def split_mode(df: DataFrame) -> DataFrame:
    """``mode`` and ``pair`` of rows made by :func:`modes_features`."""
    both = F.split("pair", _SEP)
    return df.withColumns({"mode": both[0], "pair": both[1]})


def modes_features(flagged: DataFrame, days: DataFrame, cfg: Settings, modes: Sequence[str]) -> DataFrame:
    """:func:`tape_features` of every mode from one flagged tape; ``pair`` is read with :func:`split_mode`."""
    kept = by_mode(flagged, modes).withColumn("pair", F.concat_ws(_SEP, "mode", "pair"))
    bars = with_chunks(trades_to_bars(kept, cfg), _tagged(days, modes))
    return bar_features(segment_bars(staged(bars, "bars"), cfg), cfg)


def build_datasets(
    trades: DataFrame, labels: DataFrame, cfg: Settings = DEFAULT, modes: Sequence[str] = (), stats: bool = True
) -> DataFrame:
    """:func:`build_dataset` of several modes in one pass over the tape."""
    days = active_days(trades, cfg)
    feats = modes_features(flag_modes(trades, modes, cfg, days), days, cfg, modes)
    win = split_mode(window_measures(feats, cfg, stats))
    win = label_windows(win, labels, cfg).filter(~F.col("mask")).drop("mask")
    win = staged(assign_split(win, split_bounds(labels, cfg)), "windows")
    return subsample_negatives(win, cfg, ["mode"])
