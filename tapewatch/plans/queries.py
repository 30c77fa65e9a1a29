"""Named queries: every operator applied to the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import FEATURES, FIXTURE as C, HOUR, MINUTE, MODES
from ..functions.keys import day_of, draw_int, floor_to, sigmoid
from ..functions.ranking import attach, exact_quantiles
from ..operators import bars as B, clean as K, evaluate as E, events as V, features as X
from ..operators import measures as M, models as L, reports as R, scoring as S, windows as N
from ..session import scratch_dir, staged
from ..sources import datasets as D, detectors as DT, labels as LB, trades as T
from ..streaming import live
from . import dataset as P, fixture as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
GAP_MS = 65 * MINUTE
METHOD_COLUMNS = {"b1_rule": "rule", "b2_rushorder": "rush_order", "vpin": "vpin"}
RUN_FRACS, RUN_SEEDS, RUN_BOOTS = (0.25, 0.5, 1.0), (0, 1, 2), 1000


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    # + 0.0 turns a rounded negative zero into zero
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


# ------------------------------------------------------- shared inputs
def _features(spark, root, mode="none"):
    f = P.tape_features(fx.trades(spark, root), C, mode)
    return f.filter("own").drop("own", "seg", "idx")


def _windows(spark, root, stats=False, micro=True, mode="none"):
    return P.labelled_windows(fx.trades(spark, root), fx.pumps(spark, root), C, mode, stats, micro)


def _stored_windows(spark, root):
    """The same, stored: for queries that read the windows several times."""
    return staged(_windows(spark, root), "windows")


def _measures(spark, root, stats, micro):
    f = P.tape_features(fx.trades(spark, root), C)
    return M.window_measures(f, C, stats, micro).drop("end_idx")


def scored_windows(spark, root, dataset: bool = True):
    """Sampled windows with one score per method, rounded so ties are ties everywhere."""
    w = _stored_windows(spark, root)
    w = N.subsample_negatives(w, C) if dataset else w
    w = S.with_rule_score(w, S.fit_rule(w.filter("split = 'val'")))
    w = rounded(w, *METHOD_COLUMNS.values())
    return staged(w.select("pair", "chunk_id", "end_ms", "y", "split", *METHOD_COLUMNS.values()), "scored")


def by_method(w: DataFrame, name: str = "tag") -> DataFrame:
    keep = [c for c in w.columns if c not in METHOD_COLUMNS.values()]
    one = [F.struct(F.lit(k).alias(name), F.col(v).alias("score")) for k, v in METHOD_COLUMNS.items()]
    return w.select(*keep, F.inline(F.array(*one)))


def _split(w: DataFrame, split: str) -> DataFrame:
    return w.filter(F.col("split") == split).drop("split")


def _predicted(spark, root):
    s = by_method(scored_windows(spark, root))
    val, test = _split(s, "val"), _split(s, "test")
    return staged(E.with_prediction(test, E.tune_threshold(val, ["tag"]), ["tag"]), "predicted")


def run_results(spark, root):
    """Result rows of every method at several label fractions and seeds."""
    w = scored_windows(spark, root)
    val = N.subsample_runs(_split(w, "val"), RUN_FRACS, RUN_SEEDS, GAP_MS)
    val = staged(by_method(val, "model"), "val-runs")
    test = by_method(_split(w, "test"), "model")
    frac = F.when(F.col("label_frac") < 1, F.format_string("_f%d", (F.col("label_frac") * 100).cast("int"))).otherwise("")
    tag = F.concat("model", frac, F.lit("_s"), F.col("seed").cast("string"))
    r = E.full_eval_runs(test, val, fx.pumps(spark, root), C, "model", ["label_frac", "seed"], RUN_BOOTS)
    return r.withColumn("tag", tag)


# ------------------------------------------------- sources and sinks (S)
@query
def trade_scan(spark, root):
    """Trades per pair and day of a tape."""
    return K.day_summary(fx.trades(spark, root))


@query
def tape_round_trip(spark, root):
    """Write the tape by pair and day and read it back."""
    path = scratch_dir(spark, "tape")
    T.write_tape(fx.trades(spark, root), path)
    t = T.read_tape(spark, path)
    return t.groupBy("pair", "day").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 4).alias("price_sum"))


def _day_files(spark, root):
    """The tape as one file for each pair-day, with up to two listed days without rows behind each first chunk."""
    path = scratch_dir(spark, "day-files")
    t = fx.trades(spark, root)
    last = K.chunk_map(K.day_summary(t)).filter("chunk_id = 0").groupBy("pair").agg(F.max("day").alias("last"))
    n = F.length("pair") % 3
    empty = last.filter(n > 0).select("pair", F.explode(F.sequence(F.col("last") + 1, F.col("last") + n)).alias("day"))
    T.write_day_files(t, path, empty)
    return path


@query
def day_file_chunks(spark, root):
    """Chunks from the list of day files, those without rows included."""
    path = _day_files(spark, root)
    return K.chunk_map(T.listed_days(T.day_files(spark, path), T.read_trades(spark, path)))


@query
def day_file_bars(spark, root):
    """Bars of the tape read from day files, filled over listed days without trades."""
    path = _day_files(spark, root)
    t = T.read_trades(spark, path)
    days = P.active_days(t, C, T.listed_days(T.day_files(spark, path), t))
    b = B.fill_bar_gaps(P.tape_bars(t, C, "none", days), C)
    return b.groupBy("pair", "chunk_id").agg(
        F.count(F.lit(1)).alias("bars"), F.min("bar_ms").alias("first_ms"), F.max("bar_ms").alias("last_ms"),
        F.sum("n_trades").alias("trades"), F.round(F.sum("volume"), 4).alias("volume"),
    )


@query
def dump_ingest(spark, root):
    """Text dump rows to typed trades."""
    return T.ingest_agg_trades(fx.dump_rows(spark, root))


@query
def dump_ingest_csv(spark, root):
    """The same through CSV files."""
    path = scratch_dir(spark, "dump")
    fx.dump_rows(spark, root).write.option("emptyValue", "").csv(path)
    return T.ingest_agg_trades(T.read_dump(spark, path))


@query
def label_scan(spark, root):
    """S3: labels written as CSV and read back."""
    path = scratch_dir(spark, "labels")
    p = fx.pumps(spark, root)
    p.select(
        "pair", F.lower("pair").alias("symbol"), "grp",
        F.date_format(F.timestamp_millis("pump_ms"), "yyyy-MM-dd HH:mm:ssXXX").alias("pump_time"), "source",
    ).write.option("header", "true").csv(path)
    return LB.read_labels(spark, path).select("pair", "symbol", "grp", "source", "pump_ms")


@query
def label_normalise(spark, root):
    """S4."""
    return LB.normalize_labels(fx.label_feed(spark, root), "BTC")


@query
def envelope_decode(spark, root):
    """S6."""
    return T.decode_envelope(fx.envelope_json(spark, root))


@query
def trade_decode(spark, root):
    """S7."""
    t = T.decode_trades(fx.trade_json(spark, root))
    return t.withColumn("ts_ms", F.unix_millis("ts")).drop("ts")


@query
def bar_messages(spark, root):
    """Bars as JSON messages and back."""
    b = B.trades_to_bars(fx.trades(spark, root), C)
    return rounded(live.decode_bars(live.bar_messages(b)), "quote_vol")


@query
def dataset_sink(spark, root):
    """Store the dataset, read one split, scale its end bars with the stored scaler."""
    path = scratch_dir(spark, "dataset")
    w = P.build_dataset(fx.trades(spark, root), fx.pumps(spark, root), C, "none")
    D.write_dataset(w, None, path)
    val = D.read_split(spark, path, "none", "val")
    out = D.scale_last(val, D.read_scaler(spark, path, "none"))
    return rounded(out.select("pair", "end_ms", "y", *FEATURES), *FEATURES)


@query
def dataset_pool(spark, root):
    """The stored unlabelled pool, counted per pair."""
    path = scratch_dir(spark, "dataset")
    w = P.build_dataset(fx.trades(spark, root), fx.pumps(spark, root), C, "none", stats=True)
    D.write_dataset(w, None, path)
    return D.read_pool(spark, path, "none").groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.min("end_ms").alias("first_ms"))


def _tensor_store(spark, root):
    path = scratch_dir(spark, "dataset")
    feats = staged(P.tape_features(fx.trades(spark, root), C, "adaptive"), "features")
    win = staged(P.sampled_windows(feats, fx.pumps(spark, root), C, "adaptive"), "sampled")
    D.write_dataset(win, None, path)
    D.write_tensors(feats, win, path, C)
    return path


@query
def dataset_tensor(spark, root):
    """Stored tensors of one split, standardised over the whole array; a row for each bar."""
    x = D.tensor_rows(D.read_tensors(spark, _tensor_store(spark, root), "adaptive", "val"))
    return rounded(x.select("pair", "end_ms", "y", "bar", *FEATURES), *FEATURES, digits=4)


@query
def dataset_tensor_pool(spark, root):
    """The standardised tensors of the unlabelled pool: each feature's sum over every bar of a pair."""
    x = D.tensor_rows(D.read_tensor_pool(spark, _tensor_store(spark, root), "adaptive"))
    sums = [F.round(F.sum(c), 2) + F.lit(0.0) for c in FEATURES]
    return x.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), *[v.alias(c) for v, c in zip(sums, FEATURES, strict=True)])


@query
def result_files(spark, root):
    """Result rows stored as JSON, read back, newest run per base tag."""
    path = scratch_dir(spark, "results")
    D.write_result(run_results(spark, root).drop("thr"), path, "none")
    r = D.latest_results(D.read_results(spark, path, "none"))
    return r.select("base", "tag", "f1", "precision", "recall")


@query
def file_manifest(spark, root):
    """Digests of text files, two for each pair-day of the tape."""
    path = scratch_dir(spark, "files")
    t = fx.trades(spark, root).select("pair", day_of("time").alias("day"), (F.col("agg_id") % 2).alias("part"), "agg_id")
    keys = ["pair", "day", "part"]
    t = t.repartition(*keys).sortWithinPartitions(*keys, "agg_id").select(*keys, F.col("agg_id").cast("string").alias("value"))
    t.write.partitionBy(*keys).text(path)
    return D.file_manifest(spark, {"tape": f"{path}/*/*/*/*.txt"}).select("grp", "size", "sha256")


def _manifests(spark, root):
    """Digests of the tape by pair-day at two points: as it is, and after cleaning."""
    def digest(t):
        d = day_of("time").cast("string")
        return t.groupBy(F.col("pair").alias("grp"), d.alias("path")).agg(
            F.md5(F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.sum("agg_id").cast("string"))).alias("sha256")
        )

    t = fx.trades(spark, root)
    flagged = K.flag_trades(t, "static", C)
    # some days go by another name on one side, so entries are missing and extra too
    want = digest(t)
    odd = F.crc32("path") % 5 == 0
    return want.withColumn("path", F.when(odd, F.concat(F.lit("old-"), "path")).otherwise(F.col("path"))), digest(flagged.filter("not removed"))


@query
def manifest_diff(spark, root):
    """Pair-days that differ in content or name between the tape and its cleaned form."""
    return D.manifest_diff(*_manifests(spark, root))


# ------------------------------------------------ plan and limits (P)
@query
def event_days(spark, root):
    """P1."""
    return V.event_days(fx.pumps(spark, root), C)


@query
def normal_days(spark, root):
    """P2."""
    return V.normal_days(fx.pumps(spark, root), C)


@query
def pair_day_plan(spark, root):
    """P3, A12."""
    return V.plan_counts(V.pair_day_plan(fx.pumps(spark, root), C))


@query
def first_events(spark, root):
    """P4, A9."""
    return V.first_events(fx.pumps(spark, root), 10)


@query
def first_pairs(spark, root):
    """P4."""
    return V.first_pairs(fx.pumps(spark, root), 2)


@query
def active_chunks(spark, root):
    """P5: chunks with enough trades (limit set so that some fail at sf 0.01)."""
    return P.active_days(fx.trades(spark, root), C.with_(min_chunk_trades=600))


@query
def allowed_pairs(spark, root):
    """P6."""
    b = V.allow_pairs(B.trades_to_bars(fx.trades(spark, root), C), ["purchase", "view"])
    return b.groupBy("pair").agg(F.count(F.lit(1)).alias("bars"), F.round(F.sum("volume"), 4).alias("volume"))


@query
def standardised_features(spark, root):
    """Every bar's features scaled with the train scaler."""
    w = P.build_dataset(fx.trades(spark, root), fx.pumps(spark, root), C, "none")
    f = N.standardize(_features(spark, root), N.fit_scaler(w))
    return rounded(f, *FEATURES).drop("chunk_id")


# ------------------------------------------------------- cleaning (C)
@query
def trade_dedup(spark, root):
    """C1, A8."""
    return K.dedup_trades(fx.trades_dup(spark, root)).drop("copies")


@query
def trade_returns(spark, root):
    """C2."""
    t = K.trade_returns(K.dedup_trades(fx.trades_dup(spark, root)), C)
    return rounded(t.select("pair", "agg_id", "chunk_id", "ret", "next_ret"), "ret", "next_ret")


@query
def reverting_spikes(spark, root):
    """Flagged trades at the fixed limit."""
    t = K.trade_returns(K.dedup_trades(fx.trades_dup(spark, root)), C)
    hit = K.is_reverting_spike(F.col("ret"), F.col("next_ret"), F.lit(C.static_pct))
    return t.filter(hit).select("pair", "agg_id", "time")


@query
def static_clean(spark, root):
    """C4, C7."""
    return K.clean_trades(fx.trades_dup(spark, root), "static", C).select("pair", "agg_id", "time", "price")


@query
def trade_sigma(spark, root):
    """C5."""
    t = K.trade_sigma(K.dedup_trades(fx.trades_dup(spark, root)), C)
    return rounded(t.select("pair", "agg_id", "chunk_id", "raw_sigma"), "raw_sigma")


@query
def chunk_sigma(spark, root):
    """First and median deviation per chunk."""
    t = K.trade_sigma(K.dedup_trades(fx.trades_dup(spark, root)), C)
    return rounded(K.chunk_sigma(t, C), "first_sigma", "median_sigma")


@query
def adaptive_clean(spark, root):
    """C6, C7 with limits wide enough to part spikes from moves on this tape."""
    cfg = C.with_(k0=1.5)
    return K.clean_trades(fx.trades_dup(spark, root), "adaptive", cfg).select("pair", "agg_id", "time", "price")


SPIKY = C.with_(k0=1.5)  # limits wide enough to part spikes from moves on this tape


@query
def cleaning_stats(spark, root):
    """One row per mode, from one pass."""
    return K.cleaning_stats(K.flag_modes(fx.trades_dup(spark, root), MODES, SPIKY), fx.pumps(spark, root), SPIKY)


@query
def cleaning_stats_active(spark, root):
    """One row per mode where the activity limit leaves chunks out."""
    t = fx.trades_dup(spark, root)
    chunks = K.chunk_map(K.day_summary(t))
    # chunks with less than the mean count of their kind
    limit = chunks.select("pair", "chunk_id", "chunk_trades").distinct().agg(F.avg("chunk_trades").alias("limit"))
    days = staged(attach(chunks, limit, [], ["pair", "day"]).filter(F.col("chunk_trades") >= F.col("limit")), "days")
    return K.cleaning_stats(K.flag_modes(t, MODES, SPIKY, days), fx.pumps(spark, root), SPIKY)


@query
def removed_trades(spark, root):
    """Raw trades that are not in the cleaned tape, per pair and day."""
    t = fx.trades(spark, root)
    gone = K.removed_trades(t, K.clean_trades(t, "static", C))
    return gone.groupBy("pair", day_of("time").alias("day")).agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------- bars (B)
@query
def day_chunks(spark, root):
    """B1."""
    return K.chunk_map(K.day_summary(fx.trades(spark, root)))


@query
def bars_ohlcv(spark, root):
    """B2, A1-A3."""
    return rounded(B.trades_to_bars(fx.trades(spark, root), C), "quote_vol")


@query
def bars_filled(spark, root):
    """The gap-free grid with VWAP."""
    b = B.fill_bar_gaps(staged(P.tape_bars(fx.trades(spark, root), C), "bars"), C)
    return rounded(b.drop("idx"), "quote_vol", "vwap")


@query
def bars_regrid(spark, root):
    """Streamed bars, decoded from messages, put on the grid."""
    b = live.decode_bars(live.bar_messages(B.trades_to_bars(fx.trades(spark, root), C)))
    b = B.with_chunks(b, P.active_days(fx.trades(spark, root), C))
    g = B.fill_bar_gaps(b, C)
    return rounded(g.select("pair", "chunk_id", "bar_ms", "close", "volume", "vwap"), "vwap")


@query
def minute_closes(spark, root):
    """B6."""
    return B.close_bars(fx.trades(spark, root), MINUTE)


@query
def chunk_report(spark, root):
    """B7."""
    return B.chunk_report(K.chunk_map(K.day_summary(fx.trades(spark, root))))


# ------------------------------------------------------- features (F)
@query
def bar_features(spark, root):
    """F1-F10, P7. Ratios of short decimals end on a 5 often: two more digits keep them off ties."""
    ratios = ["hl_range", "vwap_dev", "taker_buy_ratio"]
    rest = [x for x in FEATURES if x not in ratios]
    return rounded(rounded(_features(spark, root), *ratios, digits=8), *rest)


@query
def bar_features_blocks(spark, root):
    """F7-F10 by the block method used for long frames."""
    g = B.segment_bars(staged(P.tape_bars(fx.trades(spark, root), C), "bars"), C)
    f = X.bar_features(g, C, method="blocks").filter("own")
    return rounded(f.select("pair", "bar_ms", "z_vol", "z_ntr", "z_ret", "roll_sigma"), "z_vol", "z_ntr", "z_ret", "roll_sigma")


# -------------------------------------------------------- windows (W)
@query
def strided_windows(spark, root):
    """W1."""
    f = P.tape_features(fx.trades(spark, root), C)
    return N.strided_windows(f, C).drop("end_idx")


@query
def window_tensor(spark, root):
    """The tensor of every window, reduced to its shape and, for each feature, the sum and the sum weighted by place."""
    f = P.tape_features(fx.trades(spark, root), C)
    kept = N.strided_windows(f, C)
    x = N.window_tensor(f, C, kept)
    add = lambda acc, v: acc + v

    def total(i, weight):
        values = F.transform("x", lambda r, n: r[i].cast("double") * weight(n))
        return F.aggregate(values, F.lit(0.0), add)

    sums = []
    for i, name in enumerate(FEATURES):
        sums.append(F.round(total(i, lambda n: F.lit(1)), 2).alias(f"{name}_sum"))
        sums.append(F.round(total(i, lambda n: n + 1), 1).alias(f"{name}_placed"))
    return rounded(
        x.select("pair", "end_ms", F.size("x").alias("t"), F.size(F.col("x")[0]).alias("f"), *sums), *[f"{n}_{k}" for n in FEATURES for k in ("sum", "placed")], digits=2
    )


@query
def window_labels(spark, root):
    """W3, W4, J1."""
    f = P.tape_features(fx.trades(spark, root), C)
    w = N.label_windows(N.strided_windows(f, C), fx.pumps(spark, root), C)
    return w.select("pair", "end_ms", "y", "mask")


@query
def split_bounds(spark, root):
    """W5, A6."""
    return rounded(N.split_bounds(fx.pumps(spark, root), C), "t1", "t2", digits=3)


@query
def window_splits(spark, root):
    """W6."""
    return _windows(spark, root).select("pair", "end_ms", "y", "split")


@query
def straddling_windows(spark, root):
    """Windows that cross a split bound."""
    return N.straddling(_windows(spark, root), N.split_bounds(fx.pumps(spark, root), C), C)


@query
def negatives_sampled(spark, root):
    """W7."""
    return N.subsample_negatives(_stored_windows(spark, root), C).select("pair", "end_ms", "y", "split")


@query
def scaler_fit(spark, root):
    """W8, A7."""
    return rounded(N.fit_scaler(P.build_dataset(fx.trades(spark, root), fx.pumps(spark, root), C, "none")), "mean", "std")


@query
def pretrain_pool(spark, root):
    """W9."""
    w = N.subsample_negatives(_stored_windows(spark, root), C)
    return N.pretrain_pool(w).select("pair", "end_ms")


@query
def split_report(spark, root):
    """W10."""
    return N.split_report(N.subsample_negatives(_stored_windows(spark, root), C))


@query
def event_groups(spark, root):
    """W11."""
    w = staged(_windows(spark, root).select("pair", "end_ms", "y", "split"), "labels")
    return N.group_events(w, GAP_MS)


@query
def events_sampled(spark, root):
    """Half of the events and of the negatives."""
    w = staged(_windows(spark, root).select("pair", "end_ms", "y", "split"), "labels")
    return N.subsample_events(w, 0.5, 7, GAP_MS)


@query
def labels_merged(spark, root):
    """W13."""
    return V.fuzzy_dedup(fx.near_labels(spark, root))


@query
def dataset_none(spark, root):
    """W14 without cleaning."""
    return _dataset(spark, root, "none")


@query
def dataset_static(spark, root):
    """W14 with the fixed limit."""
    return _dataset(spark, root, "static")


@query
def dataset_adaptive(spark, root):
    """W14 with the adaptive limit."""
    return _dataset(spark, root, "adaptive")


def _dataset(spark, root, mode):
    w = P.build_dataset(fx.trades(spark, root), fx.pumps(spark, root), C.with_(k0=1.5), mode, stats=False)
    w = w.select("pair", "end_ms", "y", "split", "mode", "max_z_ret", "max_z_vol", "vpin")
    return rounded(w, "max_z_ret", "max_z_vol", "vpin")


# ----------------------------------------------------------- joins (J)
@query
def labels_with_data(spark, root):
    """Labels of pairs that have an active chunk on the given limit."""
    days = P.active_days(fx.trades(spark, root), C.with_(min_chunk_trades=700))
    return V.with_data(fx.pumps(spark, root), days)


@query
def event_detection(spark, root):
    """Per event, whether any of its windows alerts."""
    return E.event_hits(_predicted(spark, root), fx.pumps(spark, root), C, ["tag"])


# -------------------------------------------------------- measures (M)
@query
def window_stats(spark, root):
    """M1."""
    w = _measures(spark, root, True, False).drop("chunk_id")
    return rounded(w, *M.STATS)


@query
def microstructure(spark, root):
    """M2-M4. Price impact on a log scale: without volume it is a return over 1e-9,
    of which six decimals would be more digits than a double has."""
    w = _measures(spark, root, False, True)
    w = w.withColumns({c: F.log1p(c) for c in ("amihud", "amihud_max")})
    return rounded(w.select("pair", "end_ms", *M.MICRO), *M.MICRO)


@query
def rule_scores(spark, root):
    """M5 with the fixed limits (2, 2)."""
    w = _measures(spark, root, False, True)
    return rounded(w.select("pair", "end_ms", M.rule_score(F.lit(2.0), F.lit(2.0)).alias("score")), "score")


@query
def rush_order_scores(spark, root):
    """M6."""
    return rounded(_measures(spark, root, False, True).select("pair", "end_ms", "rush_order"), "rush_order")


# --------------------------------------------------- fit and score (L)
@query
def rule_grid(spark, root):
    """F1 of all limit pairs on the val split."""
    w = N.subsample_negatives(_stored_windows(spark, root), C).filter("split = 'val'")
    return rounded(S.rule_grid(w), "f1")


@query
def rule_fit(spark, root):
    """L1: the best limit pair."""
    w = N.subsample_negatives(_stored_windows(spark, root), C).filter("split = 'val'")
    return rounded(S.fit_rule(w), "f1")


@query
def class_weights(spark, root):
    """L2."""
    w = N.subsample_negatives(_stored_windows(spark, root), C).filter("split = 'train'")
    return rounded(S.class_weights(w), "weight", "pos_weight")


def _model_data(spark, root):
    w = P.build_dataset(fx.trades(spark, root), fx.pumps(spark, root), C, "none")
    path = scratch_dir(spark, "model-windows")
    # fitting reads the rows many times: work the tape through once
    w.write.partitionBy("split").parquet(path)
    return spark.read.parquet(path)


def _model_scores(spark, root, fit, score=L.score_model):
    w = _model_data(spark, root)
    model = fit(w.filter("split = 'train'"))
    out = score(model, w.filter("split <> 'train'"))
    return out.select("pair", "end_ms", "y", "split", "score")


@query
def model_microstructure(spark, root):
    """L3."""
    return _model_scores(spark, root, L.fit_microstructure)


@query
def model_forest(spark, root):
    """L4: 300 trees."""
    return _model_scores(spark, root, L.fit_forest)


@query
def model_logistic(spark, root):
    """L5."""
    return _model_scores(spark, root, L.fit_stat_logistic)


@query
def model_boosted(spark, root):
    """400 rounds."""
    return _model_scores(spark, root, L.fit_boosted)


@query
def model_reconstruction(spark, root):
    """Fitted on the unlabelled pool only."""
    return _model_scores(spark, root, lambda w: L.fit_reconstruction(w.filter("y = 0")), L.score_reconstruction)


@query
def score_separation(spark, root):
    """L8."""
    s = by_method(scored_windows(spark, root)).filter("split = 'val'")
    return rounded(S.score_separation(s, ["tag"]), "pos_mean", "neg_mean")


@query
def batch_scoring(spark, root):
    """A user model over Arrow batches."""
    w = _windows(spark, root).select("pair", "end_ms", "max_z_ret", "max_z_vol")
    s = S.score_windows(w, ["max_z_ret", "max_z_vol"], lambda b: 0.5 * b["max_z_ret"] + 0.25 * b["max_z_vol"])
    return rounded(s.withColumn("score", sigmoid("score")).select("pair", "end_ms", "score"), "score")


# ----------------------------------------------------- evaluation (E)
@query
def threshold_tuning(spark, root):
    """E1."""
    s = by_method(scored_windows(spark, root)).filter("split = 'val'")
    return rounded(E.tune_threshold(s, ["tag"]), "thr", "f1")


@query
def window_metrics(spark, root):
    """E2."""
    return E.window_metrics(_predicted(spark, root), ["tag"])


@query
def ranking_metrics(spark, root):
    """Over every unambiguous window of every split."""
    w = scored_windows(spark, root, dataset=False)
    return E.ranking_metrics(by_method(w), ["tag", "split"])


@query
def event_metrics(spark, root):
    """E5, E6."""
    return E.event_metrics(_predicted(spark, root), fx.pumps(spark, root), C, ["tag"])


@query
def bootstrap_ci(spark, root):
    """E7."""
    return E.bootstrap_ci(_predicted(spark, root), ["tag"])


@query
def full_evaluation(spark, root):
    """E8."""
    s = by_method(scored_windows(spark, root))
    return E.full_eval(_split(s, "test"), _split(s, "val"), fx.pumps(spark, root), C)


def _end_bars(flagged, days, modes):
    """End-bar z_ret and z_vol of every mode, one row a value."""
    ends = M.window_ends(P.modes_features(flagged, days, SPIKY, modes).filter("own"), SPIKY)
    two = F.array(*[F.struct(F.lit(x).alias("feature"), F.round(x, 6).alias("value")) for x in ("z_ret", "z_vol")])
    return staged(P.split_mode(ends).select("mode", F.inline(two)), "end-bars")


def _ks_none_adaptive(ends):
    side = lambda m: ends.filter(F.col("mode") == m).drop("mode")
    return E.ks_two_sample(side("none"), side("adaptive"), "value", ["feature"])


@query
def ks_features(spark, root):
    """End-bar z_ret and z_vol, uncleaned against adaptively cleaned, from one pass over the tape."""
    t = fx.trades(spark, root)
    days, modes = P.active_days(t, SPIKY), ["none", "adaptive"]
    k = _ks_none_adaptive(_end_bars(K.flag_modes(t, modes, SPIKY, days), days, modes))
    return rounded(k, "statistic", "p_value")


@query
def label_alignment(spark, root):
    """E10."""
    t = fx.trades(spark, root)
    counts = t.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    a = E.label_alignment(B.close_bars(t, MINUTE), counts, fx.pumps(spark, root), 12 * HOUR)
    return a


@query
def alignment_gate(spark, root):
    """The verdict over all events."""
    return E.alignment_gate(label_alignment(spark, root))


@query
def signal_gate(spark, root):
    """Val F1 of the forest against the limit."""
    s = _model_scores(spark, root, L.fit_forest).filter("split = 'val'")
    g = E.tune_threshold(s).select(F.round("f1", 4).alias("val_f1"))
    return g.withColumn("verdict", R.gate(F.col("val_f1"), 0.60))


@query
def cleaning_gate(spark, root):
    """Stats of both limits over all trades, and the change of the end bars, from one flagged tape."""
    flagged = staged(K.flag_modes(fx.trades_dup(spark, root), MODES, SPIKY), "flagged")
    stats = K.cleaning_stats(flagged, fx.pumps(spark, root), SPIKY, ["static", "adaptive"])
    days = P.active_days(flagged, SPIKY)
    active = flagged.join(days.select("pair", "chunk_id").distinct(), ["pair", "chunk_id"], "left_semi")
    ks = _ks_none_adaptive(_end_bars(active, days, ["none", "adaptive"]))
    return R.cleaning_gate(stats, ks.select(F.lit("adaptive").alias("mode"), "statistic"))


@query
def seed_gate(spark, root):
    """E13."""
    return R.seed_gate(run_results(spark, root), "vpin_f50", "b2_rushorder_f50")


@query
def method_table(spark, root):
    """E14, J9."""
    t = R.method_table(run_results(spark, root))
    return t


@query
def model_table(spark, root):
    """The result table with the fitted models beside the rules, each tuned on val."""
    w = _model_data(spark, root)
    train, rest = w.filter("split = 'train'"), w.filter("split <> 'train'")
    keep = ["pair", "end_ms", "y", "split"]
    rule = S.with_rule_score(rest, S.fit_rule(w.filter("split = 'val'")))
    parts = [by_method(rule.select(*keep, *METHOD_COLUMNS.values())).filter("tag <> 'vpin'")]
    fits = {"b3_microstructure": L.fit_microstructure, "b4_randomforest": L.fit_forest, "b5_logreg": L.fit_stat_logistic, "b6_xgboost": L.fit_boosted}
    for tag, fit in fits.items():
        parts.append(L.score_model(fit(train), rest).select(*keep, F.lit(tag).alias("tag"), "score"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    s = staged(every, "model-scores")
    r = E.full_eval(_split(s, "test"), _split(s, "val"), fx.pumps(spark, root), C, ["tag"], RUN_BOOTS)
    return R.method_table(r)


@query
def ablation_table(spark, root):
    """The rush-order score under each cleaning mode, from one pass over the tape."""
    w = P.build_datasets(fx.trades(spark, root), fx.pumps(spark, root), SPIKY, MODES, stats=False)
    w = rounded(w, "rush_order").select("pair", "end_ms", "y", "split", F.col("rush_order").alias("score"), "mode")
    s = staged(w.withColumn("tag", F.lit("b2_rushorder")), "scored")
    r = E.full_eval(_split(s, "test"), _split(s, "val"), fx.pumps(spark, root), C, ["mode", "tag"], RUN_BOOTS)
    return R.ablation_table(r, "b2_rushorder")


@query
def label_efficiency(spark, root):
    """E16."""
    return R.label_efficiency(run_results(spark, root))


@query
def missing_runs(spark, root):
    """Runs of a fourth seed are missing."""
    return R.missing_runs(run_results(spark, root), 4)


@query
def efficiency_probe(spark, root):
    """Two methods at a quarter of the labels."""
    return R.compare_at(R.label_efficiency(run_results(spark, root)), 0.25, "vpin", "b1_rule")


@query
def seed_means(spark, root):
    """E17."""
    return R.seed_means(run_results(spark, root))


@query
def score_timeline(spark, root):
    """Around the first positive test window."""
    w = scored_windows(spark, root).filter("split = 'test'").select("pair", "end_ms", "y", F.col("vpin").alias("score"))
    return E.score_timeline(w, 2 * HOUR)


@query
def label_stats(spark, root):
    """E19, A4."""
    return V.label_stats(fx.near_labels(spark, root))


@query
def label_value_counts(spark, root):
    """Most announced pairs."""
    return V.value_counts(fx.near_labels(spark, root), "pair", 10)


@query
def exchange_counts(spark, root):
    """Rows per exchange of the raw feed."""
    feed = fx.label_feed(spark, root)
    feed = feed.toDF(*[c.strip().lower() for c in feed.columns])
    return V.value_counts(feed.withColumn("exchange", F.lower("exchange")), "exchange")


# ------------------------------------------- aggregation, sets, scalars
@query
def price_quantiles(spark, root):
    """Exact quantiles per pair without holding a pair in one task."""
    q = {"p005": 0.005, "p50": 0.5, "p999": 0.999}
    return rounded(exact_quantiles(fx.trades(spark, root), ["pair"], "price", q), *q)


@query
def price_moments(spark, root):
    """A7."""
    g = fx.trades(spark, root).groupBy("pair").agg(
        F.avg("price").alias("mean"), F.stddev_pop("price").alias("sd_pop"), F.stddev_samp("price").alias("sd")
    )
    return rounded(g, "mean", "sd_pop", "sd")


@query
def latest_bars(spark, root):
    """A10, T5: the newest bars per pair."""
    b = B.trades_to_bars(fx.trades(spark, root), C).select("pair", "bar_ms", "close", "volume")
    return V.latest_per_key(b, ["pair"], "bar_ms", C.z_window + C.window_bars)


@query
def day_set_difference(spark, root):
    """Planned pair-days with no tape, and those that have one."""
    plan = V.pair_day_plan(fx.pumps(spark, root), C).select("pair", "day")
    have = K.day_summary(fx.trades(spark, root)).select("pair", "day")
    only = plan.exceptAll(have).withColumn("state", F.lit("missing"))
    both = plan.intersect(have).withColumn("state", F.lit("present"))
    return only.unionByName(both)


@query
def bootstrap_picks(spark, root):
    """Draws of §7.5: the same 32-bit draw in both engines."""
    t = fx.trades(spark, root)
    d = F.pmod(draw_int(C.seed, "pair", "agg_id"), F.lit(16))
    return t.groupBy("pair", d.alias("slot")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------- streaming (T)
STREAM_FILES = 4


def _trade_stream(spark, root, late=None):
    """The events table as a stream of trades: the files of some days in each batch; rows of ``late`` come in the last one."""
    path = scratch_dir(spark, "events")
    e = fx.events(spark, root)
    part = F.floor((F.dayofmonth("ts") - 1) * STREAM_FILES / 31)
    part = part if late is None else F.when(late, STREAM_FILES - 1).otherwise(part)
    # every quarter in as many files, so that a batch is one quarter
    width = spark.sparkContext.defaultParallelism
    e = e.withColumn("__p", part)
    for i in range(STREAM_FILES):
        e.filter(F.col("__p") == i).drop("__p").repartition(width).write.mode("append").parquet(path)
    files = spark.readStream.schema(fx.events(spark, root).schema).option("maxFilesPerTrigger", width).parquet(path)
    t = files.select(*fx.trade_columns())
    copies = F.when(F.col("agg_id") % 50 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    t = t.withColumn("__c", F.explode(copies)).drop("__c")
    return t.withColumn("ts", F.timestamp_millis("time"))


def _drain(spark, out, name):
    path = scratch_dir(spark, name)
    q = live.write_stream(out, f"{path}/checkpoint", available_now=True, path=f"{path}/data")
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/data")


@query
def stream_dedup(spark, root):
    """T1, T2."""
    out = live.dedup_stream(_trade_stream(spark, root)).drop("ts")
    return _drain(spark, out, "stream-trades")


@query
def stream_bars(spark, root):
    """Bars that the watermark has closed."""
    out = live.stream_bars(live.dedup_stream(_trade_stream(spark, root)), C)
    return rounded(_drain(spark, out, "stream-bars"), "quote_vol")


@query
def stream_messages(spark, root):
    """Closed bars written as JSON messages, read back."""
    out = live.bar_messages(live.stream_bars(live.dedup_stream(_trade_stream(spark, root)), C))
    return rounded(live.decode_bars(_drain(spark, out, "stream-messages")), "quote_vol")


def _online(spark, root, scorer=None, threshold=0.5, model="rule"):
    """Scores of every streamed bar, with the alerts beside them."""
    path = scratch_dir(spark, "online")
    bars = live.stream_bars(live.dedup_stream(_trade_stream(spark, root)), C)
    rule = lambda w: w.withColumn("score", sigmoid(M.rule_score(F.lit(2.0), F.lit(2.0))))
    closing, closed = live.relay_bars(bars, f"{path}/bars", f"{path}/closing", available_now=True)
    scoring = live.start_scoring(closed, f"{path}/out", f"{path}/scoring", scorer or rule, threshold, model, cfg=C)
    try:
        # both run side by side until the trades have ended and their last bars are scored
        closing.awaitTermination()
        scoring.processAllAvailable()
    finally:
        closing.stop()
        scoring.stop()
    return path


SCORES = "pair string, end_ms bigint, score double, age_ms bigint"


@query
def stream_scores(spark, root):
    """A score per closed bar once a window's bars exist."""
    s = spark.read.schema(SCORES).parquet(f"{_online(spark, root)}/out/scores/*")
    return rounded(s.drop("age_ms"), "score")


def _alerts(spark, path):
    schema = "symbol string, bar_time timestamp, score double, threshold double, model string, age_ms bigint"
    a = spark.read.schema(schema).json(f"{path}/out/alerts/*")
    return a.groupBy(F.col("symbol").alias("pair"), "model").agg(
        F.count(F.lit(1)).alias("alerts"), F.unix_millis(F.min("bar_time")).alias("first_ms"), F.max("score").alias("top_score")
    )


@query
def stream_alerts(spark, root):
    """Alerts per pair."""
    return _alerts(spark, _online(spark, root))


@query
def stream_model_alerts(spark, root):
    """A fitted model is stored with its tuned threshold, read by the stream and alerts."""
    store = scratch_dir(spark, "detectors")
    w = _model_data(spark, root)
    model = L.fit_microstructure(w.filter("split = 'train'"))
    best = E.tune_threshold(L.score_model(model, w.filter("split = 'val'"))).first()
    DT.save_detector(store, "b3_microstructure", model, best["thr"], spark)
    d = DT.load_detector(spark, store, "b3_microstructure")
    return _alerts(spark, _online(spark, root, d.score, d.threshold(), d.name))


@query
def stream_latency(spark, root):
    """P50 and P95 of the age of the newest 1000 scores of a stream, as they were when they were written."""
    s = spark.read.schema(SCORES).parquet(f"{_online(spark, root)}/out/scores/*")
    return live.latency_percentiles(s)


def _watched(spark, out, name):
    """What a drained stream wrote, and its listener and query."""
    path = scratch_dir(spark, name)
    listener = live.Throughput()
    spark.streams.addListener(listener)
    try:
        q = live.write_stream(out, f"{path}/checkpoint", available_now=True, path=f"{path}/data")
        q.awaitTermination()
        listener.of(q)
    finally:
        spark.streams.removeListener(listener)
    return spark.read.schema(out.schema).parquet(f"{path}/data"), listener, q


@query
def stream_lag(spark, root):
    """Closed bars and the newest one, as the batches of a running stream reported them."""
    bars = live.observed_lag(live.stream_bars(live.dedup_stream(_trade_stream(spark, root)), C))
    _, listener, q = _watched(spark, bars, "lag")
    seen = [(m["bars"], m["newest_ms"]) for m in listener.metrics(q, "lag") if m["bars"]]
    return spark.createDataFrame(seen, "bars bigint, newest_ms bigint").agg(F.sum("bars").alias("bars"), F.max("newest_ms").alias("newest_ms"))


@query
def stream_late_trades(spark, root):
    """T4: some trades of the first file come with the last one and are dropped by the watermark."""
    late = (F.col("event_id") % 97 == 0) & (F.floor((F.dayofmonth("ts") - 1) * STREAM_FILES / 31) == 0)
    out = live.dedup_stream(_trade_stream(spark, root, late)).drop("ts")
    got, listener, q = _watched(spark, out, "late")
    return got.agg(F.count(F.lit(1)).alias("kept")).withColumn("late", F.lit(int(listener.of(q)["late"])).cast("bigint"))


@query
def stream_sessions(spark, root):
    """Trades of a pair near a label and close in time, as closed sessions."""
    # a label covers a span of hours; each hour of it is matched by equality
    spans = fx.pumps(spark, root).select(
        "pair", "pump_ms", F.explode(F.sequence(floor_to(F.col("pump_ms") - C.pre_ms, HOUR), floor_to(F.col("pump_ms") + C.during_ms, HOUR), F.lit(HOUR))).alias("hour")
    )
    t = live.dedup_stream(_trade_stream(spark, root)).withColumn("hour", floor_to("time", HOUR)).join(spans, ["pair", "hour"])
    near = (F.col("time") >= F.col("pump_ms") - C.pre_ms) & (F.col("time") <= F.col("pump_ms") + C.during_ms)
    out = live.session_events(t.withColumn("y", near.cast("int")), GAP_MS)
    return _drain(spark, out, "stream-sessions")


@query
def stream_throughput(spark, root):
    """Rows read by a stream, from its progress reports."""
    written, listener, q = _watched(spark, live.dedup_stream(_trade_stream(spark, root)).drop("ts"), "throughput")
    return written.agg(F.count(F.lit(1)).alias("kept")).withColumn("read", F.lit(int(listener.of(q)["trades"])))


def flagship(spark: SparkSession, root: str) -> DataFrame:
    """Tape to scored, labelled and sampled windows."""
    w = P.build_dataset(fx.trades(spark, root), fx.pumps(spark, root), C, "adaptive", stats=False)
    w = w.withColumn("score", M.rule_score(F.lit(2.0), F.lit(2.0)))
    return w.select("pair", "chunk_id", "end_ms", "y", "split", "score", "rush_order", "vpin", "amihud")


