"""Live path: messages -> deduplicated trades -> bars -> features -> alerts.

Bars come from the same aggregates as in batch; features, windows and measures
are the batch functions themselves, run on each micro-batch with the recent
bars of the store.
"""

from __future__ import annotations

import threading
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULT, Settings
from ..functions.keys import floor_to
from ..operators.bars import bar_aggregates, segment_bars
from ..operators.events import allow_pairs
from ..operators.features import bar_features
from ..operators.measures import window_measures
from ..sources.trades import decode_trades

BAR_COLUMNS = ["open", "high", "low", "close", "volume", "n_trades", "taker_buy_vol", "quote_vol"]
SPARE_BARS = 32


# ----------------------------------------------------------------- sources
def read_trade_stream(spark: SparkSession, fmt: str = "kafka", schema: str | None = None, path: str | None = None, **options: str) -> DataFrame:
    """Trades of a stream of JSON messages in ``value``: a topic (its connector must be on the class path) or text files."""
    raw = spark.readStream.format(fmt).options(**options)
    raw = raw.schema(schema) if schema else raw
    return decode_trades(raw.load(path) if path else raw.load())


def dedup_stream(trades: DataFrame, delay: str = "30 seconds") -> DataFrame:
    """Watermark on trade time, then one row per (pair, agg_id).

    State leaves with the watermark, so it stays bounded.
    """
    return trades.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["pair", "agg_id"])


def stream_bars(trades: DataFrame, cfg: Settings = DEFAULT, wide_ids: bool = False) -> DataFrame:
    """Tumbling bars of watermarked trades: one row per closed (pair, bar)."""
    origin = floor_to("time", cfg.bar_ms)
    aggs = bar_aggregates(F.col("time"), F.col("agg_id"), origin, cfg.bar_ms, wide_ids)
    g = trades.groupBy(F.window("ts", f"{cfg.bar_ms} milliseconds").alias("w"), "pair").agg(*aggs)
    return g.select("pair", F.unix_millis("w.start").alias("bar_ms"), *BAR_COLUMNS)


# ------------------------------------------------------------------- sinks
def bar_messages(bars: DataFrame) -> DataFrame:
    """key = pair, value = the bar as JSON."""
    body = F.struct(F.col("pair").alias("symbol"), F.timestamp_millis("bar_ms").alias("bar_time"), *BAR_COLUMNS)
    return bars.select(F.col("pair").alias("key"), F.to_json(body).alias("value"))


def decode_bars(messages: DataFrame) -> DataFrame:
    schema = (
        "symbol string, bar_time timestamp, open double, high double, low double, close double, "
        "volume double, n_trades bigint, taker_buy_vol double, quote_vol double"
    )
    j = messages.select(F.from_json(F.col("value").cast("string"), schema).alias("j")).select("j.*")
    return j.select(F.col("symbol").alias("pair"), F.unix_millis("bar_time").alias("bar_ms"), *BAR_COLUMNS)


def write_stream(
    out: DataFrame, checkpoint: str, fmt: str = "parquet", available_now: bool = False, **options: str
) -> StreamingQuery:
    """Append to files or a topic; each row is written once, after the watermark."""
    w = out.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint).options(**options)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


BARS = (
    "pair string, bar_ms bigint, open double, high double, low double, close double, volume double, "
    "n_trades bigint, taker_buy_vol double, quote_vol double"
)


def relay_bars(bars: DataFrame, folder: str, checkpoint: str, available_now: bool = False) -> tuple[StreamingQuery, DataFrame]:
    """Streamed bars written to ``folder`` by a query of their own, and the stream of what it wrote.

    The keyed step of the scores cannot follow an aggregation in one query. A
    batch of the reader holds whole batches of the writer, in their order.
    """
    q = write_stream(bars, checkpoint, available_now=available_now, path=folder)
    return q, bars.sparkSession.readStream.schema(BARS).parquet(folder)


# ------------------------------------------------------------ online scores
RECENT = f"{BARS}, fresh boolean"


def keep_bars(cfg: Settings) -> int:
    """Bars of a pair that its newest window can depend on."""
    return cfg.z_window + cfg.window_bars + SPARE_BARS


def _recent_processor(keep: int, ttl_ms: int | None) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Keyed by pair: the last bars, however far back in time they lie, as one packed value.

    Only the pairs of a batch are read and written, so state traffic follows
    the pairs that moved. A pair without a bar for ``ttl_ms`` leaves. Of a bar
    sent twice the later one counts.

    The class is a local one and names nothing of this package, so it travels
    by value to workers that cannot import it.
    """
    columns = ["bar_ms", *BAR_COLUMNS]

    class RecentBars:
        def __call__(self, key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            if state.hasTimedOut:
                state.remove()
                return
            new = pd.concat(list(rows))[columns]
            held = np.frombuffer(state.get[0]).reshape(-1, len(columns)) if state.exists else np.zeros((0, len(columns)))
            # whole numbers in these columns are exact as doubles
            both = pd.concat([pd.DataFrame(held, columns=columns), new.astype("float64")])
            both = both.drop_duplicates("bar_ms", keep="last").sort_values("bar_ms")
            state.update((both.tail(keep).to_numpy("float64").tobytes(),))
            if ttl_ms:
                state.setTimeoutDuration(ttl_ms)
            out = both.astype({"bar_ms": "int64", "n_trades": "int64"})
            out.insert(0, "pair", key[0])
            yield out.assign(fresh=out["bar_ms"].isin(new["bar_ms"]))

    return RecentBars()


def recent_bars(bars: DataFrame, cfg: Settings = DEFAULT, ttl_ms: int | None = None) -> DataFrame:
    """For every pair with new bars in a batch: those (``fresh``) and the stored ones before them.

    The state is a plain one, kept by any state store: the step starts no
    worker or server of its own, neither beside the driver nor in a task.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return bars.groupBy("pair").applyInPandasWithState(
        _recent_processor(keep_bars(cfg), ttl_ms), outputStructType=RECENT, stateStructType="packed binary", outputMode="append", timeoutConf=timeout
    )


def online_windows(bars: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """A window ending at every bar, from the re-gridded recent bars."""
    live = cfg.with_(stride_bars=1)
    grid = segment_bars(bars.withColumn("chunk_id", F.lit(0)), live)
    return window_measures(bar_features(grid, live), live)


def online_alerts(scored: DataFrame, threshold: float, model: str) -> DataFrame:
    hot = scored.filter(F.col("score") >= threshold)
    return hot.select(
        F.col("pair").alias("symbol"),
        F.timestamp_millis("end_ms").alias("bar_time"),
        F.round("score", 4).alias("score"),
        F.round(F.lit(float(threshold)), 4).alias("threshold"),
        F.lit(model).alias("model"),
        F.col("age_ms") if "age_ms" in scored.columns else (F.unix_millis(F.current_timestamp()) - F.col("end_ms")).alias("age_ms"),
    )


def alert_messages(alerts: DataFrame) -> DataFrame:
    return alerts.select(F.col("symbol").alias("key"), F.to_json(F.struct(*alerts.columns)).alias("value"))


def score_batch(recent: DataFrame, cfg: Settings, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scores of a batch's fresh bars: ``scorer`` adds ``score`` to window measures."""
    fresh = recent.filter("fresh").select("pair", F.col("bar_ms").alias("end_ms"))
    return scorer(online_windows(recent.drop("fresh"), cfg)).join(fresh, ["pair", "end_ms"], "left_semi")


def start_scoring(
    bars: DataFrame,
    out: str,
    checkpoint: str,
    scorer: Callable[[DataFrame], DataFrame],
    threshold: float = 0.5,
    model: str = "model",
    pairs: list[str] | None = None,
    cfg: Settings = DEFAULT,
    available_now: bool = False,
    ttl_ms: int | None = None,
    topic: dict[str, str] | None = None,
) -> StreamingQuery:
    """Score every closed bar; scores (with their age) and alerts are kept per batch under ``out``.

    ``bars`` comes from a source of bars: a topic of bar messages, files, or
    ``relay_bars``, which passes on bars that a stream aggregates itself.
    With ``topic`` (options of a Kafka sink) alerts also go there as messages.
    A batch that is run again replaces its files. ``ttl_ms`` lets the state of
    idle pairs leave by the clock, so such a stream never runs out of batches
    and cannot be drained with ``available_now``.
    """
    if ttl_ms and available_now:
        raise ValueError("a stream whose state leaves by the clock has no last batch")

    def handle(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            age = F.unix_millis(F.current_timestamp()) - F.col("end_ms")
            cols = score_batch(batch, cfg, scorer).select("pair", "end_ms", "score", age.alias("age_ms"))
            cols.write.mode("overwrite").parquet(f"{out}/scores/epoch={epoch}")
            kept = batch.sparkSession.read.parquet(f"{out}/scores/epoch={epoch}")
            alerts = online_alerts(kept, threshold, model)
            alerts.write.mode("overwrite").json(f"{out}/alerts/epoch={epoch}")
            if topic:
                alert_messages(alerts).write.format("kafka").options(**topic).save()
        finally:
            batch.unpersist()

    w = recent_bars(allow_pairs(bars, pairs), cfg, ttl_ms).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


# --------------------------------------------------------------- monitoring
def latency_percentiles(latest: DataFrame, column: str = "age_ms", order: str = "end_ms", newest: int = 1000) -> DataFrame:
    """P50 and P95 over the newest rows, 0 until more than ten are known."""
    top = latest.orderBy(F.desc(order)).limit(newest)
    q = F.percentile(column, F.array(F.lit(0.5), F.lit(0.95)))
    g = top.agg(F.count(F.lit(1)).alias("n"), q.alias("q"))
    at = lambda i: F.when(F.col("n") > 10, F.col("q")[i]).otherwise(0.0)
    return g.select("n", at(0).alias("p50"), at(1).alias("p95"))


def observed_lag(bars: DataFrame, name: str = "lag") -> DataFrame:
    """``bars`` as they are; each batch reports how many it closed, the newest one and their greatest age."""
    age = F.unix_millis(F.current_timestamp()) - F.col("bar_ms")
    return bars.observe(name, F.count(F.lit(1)).alias("bars"), F.max("bar_ms").alias("newest_ms"), F.max(age).alias("oldest_age_ms"))


class Throughput(StreamingQueryListener):
    """Rows, working time, late rows and observed metrics of queries over their whole run, however many batches they have."""

    def __init__(self):
        self.rows: dict[str, int] = defaultdict(int)
        self.ms: dict[str, int] = defaultdict(int)
        self.late: dict[str, int] = defaultdict(int)
        self.seen: dict[str, list[tuple[str, dict]]] = defaultdict(list)
        self.ended: dict[str, threading.Event] = defaultdict(threading.Event)

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        run = str(p.runId)
        self.rows[run] += p.numInputRows
        self.ms[run] += p.durationMs.get("triggerExecution", 0)
        self.late[run] += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        self.seen[run] += [(k, v.asDict()) for k, v in p.observedMetrics.items()]

    def onQueryTerminated(self, event):
        self.ended[str(event.runId)].set()

    def of(self, query: StreamingQuery, wait: float = 60.0) -> dict[str, float]:
        """Trades, trades per second and trades dropped as late; of an ended query once its last report is in."""
        run = str(query.runId)
        if not query.isActive:
            self.ended[run].wait(wait)
        per_second = self.rows[run] / max(self.ms[run] / 1000.0, 1e-9)
        return {"trades": self.rows[run], "trades_per_sec": per_second, "late": self.late[run]}

    def metrics(self, query: StreamingQuery, name: str, wait: float = 60.0) -> list[dict]:
        """What each batch of the query reported under ``name``."""
        self.of(query, wait)
        return [m for k, m in self.seen[str(query.runId)] if k == name]


def session_events(scored: DataFrame, gap_ms: int) -> DataFrame:
    """Streaming twin of event grouping: positives of a pair at most ``gap_ms`` apart.

    ``scored`` has ts (watermarked), pair and y.
    """
    pos = scored.filter("y = 1")
    s = F.session_window("ts", f"{gap_ms + 1} milliseconds")
    g = pos.groupBy(s.alias("s"), "pair").agg(
        F.count(F.lit(1)).alias("windows"), F.max("ts").alias("last")
    )
    return g.select("pair", F.unix_millis("s.start").alias("first_ms"), F.unix_millis("last").alias("last_ms"), "windows")

