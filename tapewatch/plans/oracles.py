"""DuckDB statements that state each query's result from the raw tables."""

from __future__ import annotations

import zlib

from ..config import FEATURES, FIXTURE as C, HOUR, MINUTE

GAP_MS = 65 * MINUTE
DAY = 86_400_000
BAR, T, ST, LATE = C.bar_ms, C.window_bars, C.stride_bars, C.late_bars
METHODS = {"b1_rule": "rule", "b2_rushorder": "rush_order", "vpin": "vpin"}
STATS = [f"{x}_{s}" for s in ("mean", "std", "max", "min", "last") for x in FEATURES]
MICRO = ["ofi", "ofi_max", "vpin", "vpin_late", "amihud", "amihud_max"]


def rnd(c: str, d: int = 6) -> str:
    return f"round({c}, {d}) + 0.0 AS {c.split('.')[-1]}"


# ------------------------------------------------------------- base tables
BASE = f"""
trades AS MATERIALIZED (
  SELECT event_type AS pair, event_id AS agg_id, value AS price,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS qty,
         epoch_us(ts) // 1000 + CASE WHEN day(ts) >= 19 THEN 3 WHEN day(ts) >= 8 THEN 2 ELSE 0 END * {DAY} AS time, event_id % 2 = 1 AS is_buyer_maker
  FROM events),
trades_dup AS (SELECT * FROM trades UNION ALL SELECT * FROM trades WHERE agg_id % 50 = 0),
pumps AS MATERIALIZED (
  SELECT pair, time // {MINUTE} * {MINUTE} AS pump_ms, 'g' || (agg_id % 3) AS grp, 'synthetic' AS source
  FROM (SELECT *, row_number() OVER (PARTITION BY pair, (time + 3 * {DAY}) // (7 * {DAY})
                                     ORDER BY price DESC, agg_id) AS rn FROM trades) WHERE rn = 1),
near_labels AS (
  SELECT pair, pump_ms + m * {MINUTE} AS pump_ms, grp || g AS grp, source
  FROM pumps, (VALUES (0, ''), (10, 'x'), (40, 'y')) AS e(m, g)),
day_n AS (SELECT pair, time // {DAY} AS day, count(*) AS n FROM trades GROUP BY ALL),
day_c AS MATERIALIZED (
  SELECT pair, CAST(day AS INT) AS day, n, CAST(sum(new) OVER (PARTITION BY pair ORDER BY day) - 1 AS INT) AS chunk_id
  FROM (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY pair ORDER BY day) = 1 THEN 0 ELSE 1 END AS new FROM day_n)),
chunks AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY pair, chunk_id) AS chunk_trades FROM day_c)
"""


def cleaned(mode: str, name: str, source: str, k0: float) -> str:
    """CTEs ending in ``name``: deduplicated trades with chunk and removed flag."""
    limit = {
        "none": "NULL",
        "static": f"{C.static_pct}",
        "adaptive": f"{k0} * s * least(greatest(s / greatest(med, 1e-9), {C.clip_lo}), {C.clip_hi})",
    }[mode]
    w = "PARTITION BY pair, chunk_id ORDER BY time, agg_id"
    return f"""
{name}_d AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY pair, agg_id ORDER BY time) AS rn
             FROM {source}) WHERE rn = 1),
{name}_c AS (SELECT t.*, c.chunk_id FROM {name}_d t JOIN day_c c ON t.pair = c.pair AND t.time // {DAY} = c.day),
{name}_r AS (SELECT *, CASE WHEN lag(price) OVER w IS NULL THEN 0 ELSE ln(greatest(price, 1e-12)) - ln(greatest(lag(price) OVER w, 1e-12)) END AS ret,
             count(*) OVER (PARTITION BY pair, chunk_id) AS chunk_n FROM {name}_c WINDOW w AS ({w})),
{name}_n AS (SELECT *, coalesce(lead(ret) OVER w, 0) AS next_ret,
             CASE WHEN count(ret) OVER (w ROWS BETWEEN {C.sigma_window - 1} PRECEDING AND CURRENT ROW) >= {C.sigma_min}
               THEN stddev_samp(ret) OVER (w ROWS BETWEEN {C.sigma_window - 1} PRECEDING AND CURRENT ROW) END AS raw_sigma
             FROM {name}_r WINDOW w AS ({w})),
{name}_f AS (SELECT *, coalesce(raw_sigma, first_value(raw_sigma IGNORE NULLS) OVER
                 (PARTITION BY pair, chunk_id ORDER BY time, agg_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS fs
             FROM {name}_n),
{name}_s AS (SELECT *, CASE WHEN fs IS NOT NULL THEN greatest(fs, 1e-8) END AS s FROM {name}_f),
{name}_m AS (SELECT pair, chunk_id, median(s) AS med FROM {name}_s GROUP BY ALL),
{name} AS MATERIALIZED (SELECT x.*, med, coalesce(chunk_n >= {C.min_clean_rows} AND abs(ret) > {limit}
             AND abs(ret + next_ret) < 0.3 * abs(ret), false) AS removed
             FROM {name}_s x JOIN {name}_m USING (pair, chunk_id))
"""


CLOSED = f"bar_ms + {BAR} <= (SELECT max(time) FROM trades) - 30000"


def bars_sql(p: str, source: str, online: bool = False) -> str:
    chunked = f"""SELECT b.*, c.chunk_id FROM {p}bars b JOIN chunks c
             ON b.pair = c.pair AND b.bar_ms // {DAY} = c.day WHERE chunk_trades >= {C.min_chunk_trades}"""
    if online:  # bars the watermark has closed, on one grid per pair
        chunked = f"SELECT *, 0 AS chunk_id FROM {p}bars WHERE {CLOSED}"
    return f"""
{p}bars AS MATERIALIZED (
  SELECT pair, time // {BAR} * {BAR} AS bar_ms, arg_min(price, (time, agg_id)) AS open, max(price) AS high,
         min(price) AS low, arg_max(price, (time, agg_id)) AS close, sum(qty) AS volume, count(*) AS n_trades,
         sum(CASE WHEN NOT is_buyer_maker THEN qty ELSE 0 END) AS taker_buy_vol, sum(price * qty) AS quote_vol
  FROM {source} GROUP BY ALL),
{p}cbars AS ({chunked}),
{p}slots AS (SELECT pair, chunk_id, unnest(range(min(bar_ms), max(bar_ms) + {BAR}, {BAR})) AS bar_ms
             FROM {p}cbars GROUP BY pair, chunk_id),
{p}joined AS (SELECT s.pair, s.chunk_id, s.bar_ms, open, high, low, volume, n_trades, taker_buy_vol, quote_vol,
                last_value(close IGNORE NULLS) OVER (PARTITION BY s.pair, s.chunk_id ORDER BY s.bar_ms
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close
              FROM {p}slots s LEFT JOIN {p}cbars b ON s.pair = b.pair AND s.chunk_id = b.chunk_id AND s.bar_ms = b.bar_ms),
{p}grid AS MATERIALIZED (
  SELECT pair, chunk_id, bar_ms, coalesce(open, close) AS open, coalesce(high, close) AS high, coalesce(low, close) AS low,
         close, coalesce(volume, 0.0) AS volume, CAST(coalesce(n_trades, 0) AS BIGINT) AS n_trades,
         coalesce(taker_buy_vol, 0.0) AS taker_buy_vol, coalesce(quote_vol, 0.0) AS quote_vol,
         CASE WHEN volume > 0 THEN quote_vol / volume ELSE close END AS vwap
  FROM {p}joined)
"""


def features_sql(p: str) -> str:
    zero = lambda c: f"CASE WHEN {c} IS NULL OR isnan({c}) OR isinf({c}) THEN 0.0 ELSE {c} END AS {c}"
    z = lambda c: (
        f"CASE WHEN count({c}) OVER z >= {C.z_min} THEN ({c} - avg({c}) OVER z) / (stddev_samp({c}) OVER z + 1e-9) END"
    )
    return f"""
{p}f0 AS (SELECT *, CASE WHEN close > 0 THEN ln(close) END AS lc,
     CASE WHEN close <> 0 THEN (high - low) / close END AS hl_range,
     CASE WHEN vwap <> 0 THEN (close - vwap) / vwap END AS vwap_dev,
     CASE WHEN volume > 0 THEN taker_buy_vol / volume ELSE 0.5 END AS taker_buy_ratio,
     ln(1 + volume) AS log_vol, ln(1 + CAST(n_trades AS DOUBLE)) AS log_ntr FROM {p}grid),
{p}f1 AS (SELECT *, lc - lag(lc) OVER (PARTITION BY pair, chunk_id ORDER BY bar_ms) AS ret FROM {p}f0),
{p}f2 AS (SELECT *, {z('log_vol')} AS z_vol, {z('log_ntr')} AS z_ntr,
     CASE WHEN count(ret) OVER v >= {C.vol_min} THEN stddev_samp(ret) OVER v END AS roll_sigma FROM {p}f1
   WINDOW z AS (PARTITION BY pair, chunk_id ORDER BY bar_ms ROWS BETWEEN {C.z_window - 1} PRECEDING AND CURRENT ROW),
          v AS (PARTITION BY pair, chunk_id ORDER BY bar_ms ROWS BETWEEN {C.vol_window - 1} PRECEDING AND CURRENT ROW)),
{p}f3 AS (SELECT *, ret / (roll_sigma + 1e-9) AS z_ret FROM {p}f2),
{p}feats AS MATERIALIZED (SELECT pair, chunk_id, bar_ms, {', '.join(zero(x) for x in FEATURES)} FROM {p}f3)
"""


def windows_sql(p: str, stats: bool = False, stride: int = ST) -> str:
    st = ""
    if stats:
        parts = []
        for x in FEATURES:
            parts += [
                f"avg({x}) OVER w AS {x}_mean", f"stddev_pop({x}) OVER w AS {x}_std", f"max({x}) OVER w AS {x}_max",
                f"min({x}) OVER w AS {x}_min", f"{x} AS {x}_last",
            ]
        st = ", " + ", ".join(parts)
    frame = "PARTITION BY pair, chunk_id ORDER BY bar_ms ROWS BETWEEN {} PRECEDING AND CURRENT ROW"
    return f"""
{p}w0 AS (SELECT *, exp(log_vol) - 1 AS vol, row_number() OVER (PARTITION BY pair, chunk_id ORDER BY bar_ms) AS rn FROM {p}feats),
{p}w1 AS (SELECT *, vol * taker_buy_ratio AS buy, vol * (1 - taker_buy_ratio) AS sell FROM {p}w0),
{p}w2 AS (SELECT pair, chunk_id, bar_ms AS end_ms, rn,
     sum(buy) OVER w - sum(sell) OVER w AS ofi, max(buy - sell) OVER w AS ofi_max,
     abs(sum(buy) OVER w - sum(sell) OVER w) / (sum(vol) OVER w + 1e-9) AS vpin,
     abs(sum(buy) OVER l - sum(sell) OVER l) / (sum(vol) OVER l + 1e-9) AS vpin_late,
     avg(abs(ret)) OVER w / (avg(vol) OVER w + 1e-9) AS amihud, max(abs(ret)) OVER w / (avg(vol) OVER w + 1e-9) AS amihud_max,
     max(z_ret) OVER w AS max_z_ret, max(z_vol) OVER w AS max_z_vol,
     max(greatest(z_ntr, 0) * greatest(taker_buy_ratio - 0.5, 0)) OVER w AS rush_order{st}
   FROM {p}w1 WINDOW w AS ({frame.format(T - 1)}), l AS ({frame.format(LATE - 1)})),
{p}win AS MATERIALIZED (SELECT * EXCLUDE rn FROM {p}w2 WHERE rn >= {T} AND (rn - {T}) % {stride} = 0),
{p}lab AS MATERIALIZED (SELECT w.*, coalesce(y, 0) AS y, coalesce(buf, 0) = 1 AND coalesce(y, 0) = 0 AS mask
   FROM {p}win w LEFT JOIN (
     SELECT w.pair, w.end_ms, max(CASE WHEN end_ms >= pump_ms - {C.pre_ms} AND end_ms <= pump_ms + {C.during_ms} THEN 1 ELSE 0 END) AS y,
            max(CASE WHEN abs(end_ms - pump_ms) <= {C.buffer_ms} THEN 1 ELSE 0 END) AS buf
     FROM {p}win w JOIN pumps USING (pair) GROUP BY ALL) m USING (pair, end_ms)),
{p}bounds AS (SELECT quantile_cont(CAST(pump_ms AS DOUBLE), {C.train_frac}) AS t1,
                     quantile_cont(CAST(pump_ms AS DOUBLE), {C.train_frac + C.val_frac}) AS t2 FROM pumps),
{p}allw AS MATERIALIZED (SELECT * EXCLUDE (mask, t1, t2),
     CASE WHEN end_ms <= t1 THEN 'train' WHEN end_ms <= t2 THEN 'val' ELSE 'test' END AS split
   FROM {p}lab, {p}bounds WHERE NOT mask),
{p}caps AS (SELECT split, CAST(floor((CASE WHEN split = 'train' THEN {C.neg_ratio_train} ELSE {C.neg_cap_eval} END)
              * greatest(sum(y), 1)) AS BIGINT) AS cap FROM {p}allw GROUP BY split),
{p}rank AS (SELECT *, row_number() OVER (PARTITION BY split, y ORDER BY md5('{C.seed}|' || pair || '|' || end_ms)) AS rk FROM {p}allw),
{p}ds AS MATERIALIZED (SELECT r.* EXCLUDE rk FROM {p}rank r JOIN {p}caps USING (split) WHERE y = 1 OR rk <= cap)
"""


def chain(p: str = "", mode: str = "none", stats: bool = False, k0: float = 1.5) -> str:
    if mode == "none":
        clean, source = "", "trades"
    else:
        clean, source = cleaned(mode, f"{p}cl", "trades", k0) + ",", f"(SELECT * FROM {p}cl WHERE NOT removed)"
    return ",".join([clean + bars_sql(p, source), features_sql(p), windows_sql(p, stats)])


def q(select: str, *ctes: str) -> str:
    return "WITH " + ",".join([BASE, *ctes]) + select


RULE = f"""
rgrid AS (SELECT a.i * 0.25 + 0.5 AS a, b.i * 0.25 + 0.5 AS b FROM range(31) a(i), range(31) b(i)),
rcount AS (SELECT a, b, CAST(sum(CASE WHEN max_z_ret > a AND max_z_vol > b THEN y ELSE 0 END) AS BIGINT) AS tp,
    CAST(sum(CASE WHEN max_z_ret > a AND max_z_vol > b THEN 1 - y ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN max_z_ret > a AND max_z_vol > b THEN 0 ELSE y END) AS BIGINT) AS fn
  FROM rgrid, (SELECT * FROM {{src}} WHERE split = 'val') GROUP BY a, b),
rf1 AS (SELECT *, 2 * tp / greatest(2 * tp + fp + fn, 1) AS f1 FROM rcount),
rbest AS (SELECT * FROM rf1 ORDER BY round(f1, 12) DESC, a, b LIMIT 1)
"""


def scored(src: str = "ds") -> str:
    cols = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("rush_order", "vpin"))
    union = " UNION ALL ".join(f"SELECT pair, end_ms, y, split, '{k}' AS tag, {v} AS score FROM wide" for k, v in METHODS.items())
    return (
        RULE.format(src=src)
        + f""",
wide AS MATERIALIZED (SELECT pair, chunk_id, end_ms, y, split, round(least(max_z_ret - a, max_z_vol - b), 6) + 0.0 AS rule, {cols}
   FROM {src}, (SELECT a, b FROM rbest)),
scored AS MATERIALIZED ({union})"""
    )


def tuned(src: str, keys: str, out: str = "best") -> str:
    k = keys
    return f"""
{out}_q AS (SELECT {k}, quantile_cont(score, 0.005) AS lo, quantile_cont(score, 0.999) AS hi FROM {src} GROUP BY {k}),
{out}_t AS (SELECT {k}, i, CASE WHEN i = 299 THEN hi ELSE lo + i * ((hi - lo) / 299) END AS t FROM {out}_q, range(300) r(i)),
{out}_n AS (SELECT {k}, i, t, CAST(sum(CASE WHEN score >= t THEN y ELSE 0 END) AS BIGINT) AS tp,
     CAST(sum(CASE WHEN score >= t THEN 1 - y ELSE 0 END) AS BIGINT) AS fp,
     CAST(sum(CASE WHEN score >= t THEN 0 ELSE y END) AS BIGINT) AS fn
   FROM {out}_t JOIN {src} USING ({k}) GROUP BY ALL),
{out}_r AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY
     CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END DESC, i) AS rk,
     CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM {out}_n),
{out} AS MATERIALIZED (SELECT {k}, t AS thr, f1 FROM {out}_r WHERE rk = 1)"""


def metrics(pred: str, keys: str, boots: int, out: str = "m") -> str:
    """CTEs {out}_w, {out}_k, {out}_e, {out}_b over ``pred``."""
    k = keys
    f1 = "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END"
    sums = (
        "CAST(sum(pred * y) AS BIGINT) AS tp, CAST(sum(pred * (1 - y)) AS BIGINT) AS fp, CAST(sum((1 - pred) * y) AS BIGINT) AS fn"
    )
    return f"""
{out}_s AS (SELECT {k}, {sums} FROM {pred} GROUP BY {k}),
{out}_w AS (SELECT {k}, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 4) AS precision,
     round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 4) AS recall, round({f1}, 4) AS f1 FROM {out}_s),
{out}_g AS (SELECT {k}, score, sum(y) AS p, count(*) - sum(y) AS n FROM {pred} GROUP BY {k}, score),
{out}_c AS (SELECT *, sum(p) OVER u AS tp, sum(n) OVER u AS fp FROM {out}_g
     WINDOW u AS (PARTITION BY {k} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{out}_k AS (SELECT {k}, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN round(sum(n * (tp - p) + n * p / 2) / (sum(p) * sum(n)), 4) END AS roc_auc,
     CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN round(sum(p * tp / (tp + fp)) / sum(p), 4) END AS pr_auc FROM {out}_c GROUP BY {k}),
{out}_h AS (SELECT {k}, pair, pump_ms, max(pred) AS detected FROM {pred} JOIN pumps USING (pair)
     WHERE end_ms >= pump_ms - {C.pre_ms} AND end_ms <= pump_ms + {C.during_ms} GROUP BY ALL),
{out}_e AS (SELECT * FROM (SELECT {k}, round(sum(detected) / greatest(count(*), 1), 4) AS event_recall,
       CAST(sum(detected) AS BIGINT) AS events_detected, count(*) AS events_total FROM {out}_h GROUP BY {k})
     JOIN (SELECT {k}, round(sum(pred * (1 - y)) / greatest(count(DISTINCT (pair, end_ms // {DAY})), 1), 3) AS fa_per_symbol_day
       FROM {pred} GROUP BY {k}) USING ({k})),
{out}_p AS (SELECT {k}, pair, {sums} FROM {pred} GROUP BY {k}, pair),
{out}_i AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY md5('0|' || pair)) - 1 AS slot,
     count(*) OVER (PARTITION BY {k}) AS pairs FROM {out}_p),
{out}_d AS (SELECT {k}, boot, CAST(('0x' || substr(md5('0|' || boot || '|' || slot), 1, 8)) AS UBIGINT) % pairs AS slot
     FROM {out}_i, range({boots}) r(boot)),
{out}_f AS (SELECT {k}, boot, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn
     FROM {out}_d JOIN {out}_i USING ({k}, slot) GROUP BY {k}, boot),
{out}_b AS (SELECT {k}, round(quantile_cont(f1, 0.025), 4) AS f1_lo, round(quantile_cont(f1, 0.975), 4) AS f1_hi
     FROM (SELECT {k}, {f1} AS f1 FROM {out}_f WHERE tp + fn > 0) GROUP BY {k})"""


def predicted(test: str, best: str, keys: str, out: str = "pred") -> str:
    return f"""
{out} AS MATERIALIZED (SELECT s.*, thr, f1 AS val_f1, CASE WHEN score >= thr THEN 1 ELSE 0 END AS pred
   FROM {test} s JOIN {best} USING ({keys}))"""


EVAL = ",".join([
    chain(), scored(), tuned("(SELECT * FROM scored WHERE split = 'val')", "tag"),
    predicted("(SELECT * EXCLUDE split FROM scored WHERE split = 'test')", "best", "tag"), metrics("pred", "tag", 1000),
])


def events_of(src: str, out: str = "ev") -> str:
    w = "PARTITION BY pair ORDER BY end_ms"
    return f"""
{out}_l AS (SELECT pair, end_ms, CASE WHEN end_ms - lag(end_ms) OVER ({w}) <= {GAP_MS} THEN 0 ELSE 1 END AS new FROM {src} WHERE y = 1),
{out} AS MATERIALIZED (SELECT pair, end_ms, CAST(sum(new) OVER (ORDER BY pair, end_ms) - 1 AS BIGINT) AS event_id FROM {out}_l)"""


def shares(src: str, ev: str, runs: str, out: str) -> str:
    """A share of events and negatives of ``src`` per run of ``runs`` (label_frac, seed)."""
    k = "label_frac, seed"
    return f"""
{out}_e AS (SELECT {k}, event_id, row_number() OVER (PARTITION BY {k} ORDER BY md5(seed || '|e|' || event_id)) AS rk,
     greatest(round_even(count(*) OVER (PARTITION BY {k}) * label_frac, 0), 1) AS cap
   FROM (SELECT DISTINCT event_id FROM {ev}), {runs}),
{out}_n AS (SELECT w.*, {k}, row_number() OVER (PARTITION BY {k} ORDER BY md5(seed || '|n|' || pair || '|' || end_ms)) AS rk,
     greatest(floor(count(*) OVER (PARTITION BY {k}) * label_frac), 1) AS cap FROM {src} w, {runs} WHERE y = 0),
{out} AS MATERIALIZED (SELECT w.*, {k} FROM {src} w JOIN {ev} USING (pair, end_ms)
     JOIN (SELECT * FROM {out}_e WHERE rk <= cap) USING (event_id) WHERE y = 1
   UNION ALL SELECT * EXCLUDE (rk, cap) FROM {out}_n WHERE rk <= cap)"""


def long_form(src: str, extra: str) -> str:
    return " UNION ALL ".join(
        f"SELECT pair, end_ms, y, {extra}, '{k}' AS model, {v} AS score FROM {src}" for k, v in METHODS.items()
    )


RUN_KEYS = "model, label_frac, seed"
RESULTS = ",".join([
    chain(), scored(), events_of("(SELECT * FROM wide WHERE split = 'val')"),
    "runs AS (SELECT CAST(f AS DOUBLE) AS label_frac, s AS seed FROM (VALUES (0.25), (0.5), (1.0)) a(f), range(3) b(s))",
    "valw AS (SELECT * EXCLUDE split FROM wide WHERE split = 'val')",
    shares("valw", "ev", "runs", "vr"),
    f"vlong AS MATERIALIZED ({long_form('vr', 'label_frac, seed')})",
    f"tlong AS MATERIALIZED ({long_form('(SELECT * FROM wide, runs WHERE split = $$test$$)', 'label_frac, seed')})",
    tuned("vlong", RUN_KEYS), predicted("tlong", "best", RUN_KEYS), metrics("pred", RUN_KEYS, 1000),
    f"""results AS MATERIALIZED (SELECT *, model || CASE WHEN label_frac < 1 THEN '_f' || CAST(label_frac * 100 AS INT) ELSE '' END
        || '_s' || seed AS tag FROM m_w JOIN m_k USING ({RUN_KEYS}) LEFT JOIN m_e USING ({RUN_KEYS}) JOIN m_b USING ({RUN_KEYS}))""",
    r"based AS (SELECT *, regexp_replace(tag, '_s\d+$', '') AS base FROM results)",
    "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY tag DESC) AS rn FROM based) WHERE rn = 1)",
])
REPORT = ["precision", "recall", "f1", "roc_auc", "pr_auc", "event_recall", "fa_per_symbol_day", "f1_lo", "f1_hi"]


def stats_row(mode: str, name: str) -> str:
    near = f"""EXISTS (SELECT 1 FROM pumps p WHERE p.pair = c.pair AND c.time >= pump_ms - {C.pre_ms} AND c.time <= pump_ms + {C.during_ms})"""
    return f"""SELECT (SELECT count(*) FROM trades_dup) AS ticks_in, CAST(sum(CASE WHEN removed THEN 0 ELSE 1 END) AS BIGINT) AS ticks_out,
      (SELECT count(*) FROM trades_dup) - CAST(sum(CASE WHEN removed THEN 0 ELSE 1 END) AS BIGINT) AS removed,
      CAST(sum(CASE WHEN removed AND near THEN 1 ELSE 0 END) AS BIGINT) AS removed_in_pump,
      CAST(sum(CASE WHEN removed AND NOT near THEN 1 ELSE 0 END) AS BIGINT) AS removed_in_normal,
      round(100.0 * ((SELECT count(*) FROM trades_dup) - sum(CASE WHEN removed THEN 0 ELSE 1 END))
            / greatest((SELECT count(*) FROM trades_dup), 1), 4) AS removed_pct, '{mode}' AS mode
    FROM (SELECT *, {near} AS near FROM {name} c)"""


def ks_sql() -> str:
    ends = lambda p, k: " UNION ALL ".join(
        f"SELECT '{x}' AS feature, round({x}, 6) AS v, {k} AS k FROM (SELECT *, row_number() OVER (PARTITION BY pair, chunk_id ORDER BY bar_ms) AS rn FROM {p}feats) WHERE rn >= {T} AND (rn - {T}) % {ST} = 0"
        for x in ("z_ret", "z_vol")
    )
    return f"""
ks_v AS ({ends('', 0)} UNION ALL {ends('ad_', 1)}),
ks_c AS (SELECT feature, v, sum(1 - k) AS a, sum(k) AS b FROM ks_v GROUP BY feature, v),
ks_r AS (SELECT *, sum(a) OVER u AS ca, sum(b) OVER u AS cb, sum(a) OVER (PARTITION BY feature) AS n1, sum(b) OVER (PARTITION BY feature) AS n2
   FROM ks_c WINDOW u AS (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ks_d AS (SELECT feature, CAST(max(n1) AS BIGINT) AS n1, CAST(max(n2) AS BIGINT) AS n2, max(abs(ca / n1 - cb / n2)) AS ks FROM ks_r GROUP BY feature),
ks AS (SELECT feature, n1, n2, CASE WHEN n1 > 100 AND n2 > 100 THEN ks END AS statistic,
   CASE WHEN n1 > 100 AND n2 > 100 THEN CASE WHEN ks = 0 THEN 1.0 ELSE least(greatest(
     (SELECT sum((CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * k * k * (n1 * n2 / (n1 + n2)) * ks * ks)) FROM range(1, 101) r(k)), 0), 1) END END AS p_value
   FROM ks_d)"""


ALIGN = f"""
closes AS (SELECT pair, time // {MINUTE} * {MINUTE} AS bar_ms, arg_max(price, (time, agg_id)) AS close FROM trades GROUP BY ALL),
al0 AS (SELECT p.pair, p.pump_ms, count(bar_ms) AS minutes, avg(CASE WHEN bar_ms <= pump_ms THEN close END) AS pre,
     max(CASE WHEN bar_ms >= pump_ms THEN close END) AS post
   FROM pumps p LEFT JOIN closes c ON p.pair = c.pair AND abs(bar_ms - pump_ms) <= {12 * HOUR} GROUP BY ALL),
al1 AS (SELECT *, coalesce(CASE WHEN pre <> 0 THEN (post - pre) / pre * 100 END, 0) AS spike,
     (SELECT count(*) FROM trades t WHERE t.pair = al0.pair) AS n FROM al0),
align AS (SELECT pair, pump_ms, CASE WHEN n < 100 THEN 'NO_DATA' WHEN minutes < 10 THEN 'INSUFFICIENT_DATA'
     WHEN spike > 2.0 THEN 'ALIGNED' ELSE 'WEAK' END AS status, spike FROM al1)"""

SESSIONS = f"""
sess_t AS (SELECT *, CASE WHEN time - lag(time) OVER (PARTITION BY pair ORDER BY time, agg_id) <= {GAP_MS} THEN 0 ELSE 1 END AS new
   FROM (SELECT t.* FROM trades t JOIN pumps p ON t.pair = p.pair AND time >= pump_ms - {C.pre_ms} AND time <= pump_ms + {C.during_ms})),
sess_i AS (SELECT *, sum(new) OVER (PARTITION BY pair ORDER BY time, agg_id) AS sid FROM sess_t),
sess AS (SELECT pair, min(time) AS first_ms, max(time) AS last_ms, count(*) AS windows FROM sess_i GROUP BY pair, sid)"""

PLAN = f"""
ev_days AS (SELECT DISTINCT pair, CAST(pump_ms // {DAY} + d AS INT) AS day FROM pumps, range(-{C.days_before}, {C.days_after} + 1) r(d)),
cand AS (SELECT pair, back, CAST(min(pump_ms) // {DAY} - back AS INT) AS day FROM pumps, range(7, 180, 7) r(back) GROUP BY pair, back),
free AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY back) AS rn FROM cand c
   WHERE NOT EXISTS (SELECT 1 FROM pumps p WHERE p.pair = c.pair AND p.pump_ms // {DAY} = c.day)),
no_days AS (SELECT pair, day FROM free WHERE rn <= {C.normal_days}),
planned AS (SELECT * FROM ev_days UNION SELECT * FROM no_days)"""


def feats_out(p: str = "") -> str:
    return ", ".join(rnd(x, 8 if x in ("hl_range", "vwap_dev", "taker_buy_ratio") else 6) for x in FEATURES)


SCALER = "scaler AS (" + " UNION ALL ".join(
    f"SELECT '{x}' AS feature, avg({x}_mean) AS mean, sqrt(avg({x}_std * {x}_std) + var_pop({x}_mean)) + 1e-8 AS std FROM ds WHERE split = 'train'"
    for x in FEATURES
) + ")"
SCALED = ", ".join(
    f"round(({{}}{x}{{}} - (SELECT mean FROM scaler WHERE feature = '{x}')) / (SELECT std FROM scaler WHERE feature = '{x}'), 6) + 0.0 AS {x}"
    for x in FEATURES
)


def statements() -> dict[str, str]:
    base, full = chain(), chain(stats=True)
    dup = {m: cleaned(m, f"d_{m}", "trades_dup", 1.5) for m in ("none", "static", "adaptive")}
    online = ",".join([bars_sql("on_", "trades", online=True), features_sql("on_"), windows_sql("on_", stride=1)]) + """,
      live AS (SELECT w.pair, end_ms, 1 / (1 + exp(-least(max_z_ret - 2, max_z_vol - 2))) AS score
        FROM on_win w JOIN on_cbars b ON w.pair = b.pair AND w.end_ms = b.bar_ms)"""
    barcols = "pair, bar_ms, open, high, low, close, volume, n_trades, taker_buy_vol, round(quote_vol, 6) + 0.0 AS quote_vol"
    o = {}
    o["trade_scan"] = q("SELECT pair, CAST(day AS INT) AS day, n FROM day_n")
    o["tape_round_trip"] = q(f"SELECT pair, CAST(time // {DAY} AS INT) AS day, count(*) AS n, round(sum(price), 4) AS price_sum FROM trades GROUP BY ALL")
    ingest = "SELECT agg_id, price, qty, time, is_buyer_maker FROM trades WHERE agg_id % 97 <> 0"
    o["dump_ingest"] = o["dump_ingest_csv"] = q(ingest)
    o["label_scan"] = q("SELECT pair, lower(pair) AS symbol, grp, source, pump_ms FROM pumps")
    o["label_normalise"] = q("""SELECT upper(pair) || 'BTC' AS pair, lower(pair) AS symbol, grp, pump_ms, 'feed' AS source
        FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY pump_ms) AS n FROM pumps) WHERE n % 4 <> 0""")
    o["envelope_decode"] = q("SELECT * FROM trades WHERE agg_id % 10 <> 0")
    o["trade_decode"] = q("SELECT *, time AS ts_ms FROM trades")
    o["bar_messages"] = q(f"SELECT {barcols} FROM bars", bars_sql("", "trades"))
    o["bars_ohlcv"] = o["bar_messages"]
    o["dataset_sink"] = q(f"SELECT pair, end_ms, y, {SCALED.format(*['', '_last'] * len(FEATURES))} FROM ds WHERE split = 'val'", full, SCALER)
    o["dataset_pool"] = q("SELECT pair, count(*) AS n, min(end_ms) AS first_ms FROM ds WHERE split = 'train' AND y = 0 GROUP BY pair", base)
    o["result_files"] = q("SELECT base, tag, f1, precision, recall FROM newest", RESULTS)
    odd = ", ".join(str(d) for d in range(19_700, 19_800) if zlib.crc32(str(d).encode()) % 5 == 0)
    digest = f"pair AS grp, CAST(time // {DAY} AS VARCHAR) AS path, md5(count(*) || '|' || sum(agg_id)) AS h"
    o["manifest_diff"] = q(f"""SELECT grp, CAST(sum(CASE WHEN g.h IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing,
          CAST(sum(CASE WHEN w.h IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS extra, CAST(sum(CASE WHEN w.h <> g.h THEN 1 ELSE 0 END) AS BIGINT) AS changed,
          CASE WHEN sum(CASE WHEN g.h IS NULL OR w.h <> g.h THEN 1 ELSE 0 END) > 0 THEN 'MISMATCH' ELSE 'OK' END AS status
        FROM (SELECT grp, CASE WHEN day IN ({odd}) THEN 'old-' || path ELSE path END AS path, h FROM (SELECT {digest}, time // {DAY} AS day FROM trades GROUP BY pair, time // {DAY})) w
        FULL JOIN (SELECT {digest} FROM mcl WHERE NOT removed GROUP BY pair, time // {DAY}) g USING (grp, path) GROUP BY grp""",
        cleaned("static", "mcl", "trades", 6.0))
    o["event_days"] = q("SELECT * FROM ev_days", PLAN)
    o["normal_days"] = q("SELECT * FROM no_days", PLAN)
    o["pair_day_plan"] = q("SELECT pair, count(*) AS days FROM planned GROUP BY pair", PLAN)
    o["first_events"] = q("SELECT * FROM pumps ORDER BY pump_ms, pair LIMIT 10")
    o["first_pairs"] = q("SELECT * FROM pumps WHERE pair IN (SELECT pair FROM pumps GROUP BY pair ORDER BY min(pump_ms), pair LIMIT 2)")
    o["active_chunks"] = q("SELECT pair, day, n, chunk_id, CAST(chunk_trades AS BIGINT) AS chunk_trades FROM chunks WHERE chunk_trades >= 600")
    o["day_chunks"] = q("SELECT pair, day, n, chunk_id, CAST(chunk_trades AS BIGINT) AS chunk_trades FROM chunks")
    o["allowed_pairs"] = q("SELECT pair, count(*) AS bars, round(sum(volume), 4) AS volume FROM bars WHERE pair IN ('purchase', 'view') GROUP BY pair", bars_sql("", "trades"))
    listed = f"""ld AS (SELECT pair, day, n FROM day_n UNION ALL
        SELECT pair, unnest(range(last + 1, last + 1 + length(pair) % 3)) AS day, 0 AS n FROM (SELECT pair, max(day) AS last FROM day_c WHERE chunk_id = 0 GROUP BY pair)),
      lc AS (SELECT pair, CAST(day AS INT) AS day, n, CAST(sum(new) OVER (PARTITION BY pair ORDER BY day) - 1 AS INT) AS chunk_id
        FROM (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY pair ORDER BY day) = 1 THEN 0 ELSE 1 END AS new FROM ld)),
      lchunks AS (SELECT *, sum(n) OVER (PARTITION BY pair, chunk_id) AS chunk_trades FROM lc)"""
    o["day_file_chunks"] = q("SELECT pair, day, n, chunk_id, CAST(chunk_trades AS BIGINT) AS chunk_trades FROM lchunks", listed)
    o["day_file_bars"] = q("""SELECT pair, chunk_id, count(*) AS bars, min(bar_ms) AS first_ms, max(bar_ms) AS last_ms, CAST(sum(n_trades) AS BIGINT) AS trades, round(sum(volume), 4) AS volume
        FROM grid GROUP BY ALL""", listed, bars_sql("", "trades").replace("JOIN chunks c", "JOIN lchunks c"))
    whole = chain(mode="adaptive", stats=True, k0=C.k0)
    bars_of = f"""xb AS (SELECT d.pair, d.end_ms, d.y, d.split, CAST({T - 1} - (d.rn - f.rn) AS INT) AS bar, {', '.join(f'f.{x}' for x in FEATURES)}
        FROM (SELECT ds.*, r.rn FROM ds JOIN fr r ON ds.pair = r.pair AND ds.chunk_id = r.chunk_id AND ds.end_ms = r.bar_ms) d
        JOIN fr f ON d.pair = f.pair AND d.chunk_id = f.chunk_id AND f.rn BETWEEN d.rn - {T - 1} AND d.rn)"""
    fr = f"fr AS MATERIALIZED (SELECT pair, chunk_id, bar_ms, {', '.join(f'CAST({x} AS FLOAT)::DOUBLE AS {x}' for x in FEATURES)}, row_number() OVER (PARTITION BY pair, chunk_id ORDER BY bar_ms) AS rn FROM feats)"
    wide4 = SCALED.format(*["", ""] * len(FEATURES)).replace(", 6) + 0.0", ", 4) + 0.0")
    o["dataset_tensor"] = q(f"SELECT pair, end_ms, y, bar, {wide4} FROM xb WHERE split = 'val'", whole, SCALER, fr, bars_of)
    pool = ", ".join(
        f"round(sum(({x} - (SELECT mean FROM scaler WHERE feature = '{x}')) / (SELECT std FROM scaler WHERE feature = '{x}')), 2) + 0.0 AS {x}" for x in FEATURES
    )
    o["dataset_tensor_pool"] = q(f"SELECT pair, count(*) AS n, {pool} FROM xb WHERE split = 'train' AND y = 0 GROUP BY pair", whole, SCALER, fr, bars_of)
    o["standardised_features"] = q(f"SELECT pair, bar_ms, {SCALED.format(*['', ''] * len(FEATURES))} FROM feats", full, SCALER)
    o["trade_dedup"] = q("SELECT * FROM trades")
    o["trade_returns"] = q("SELECT pair, agg_id, chunk_id, round(ret, 6) + 0.0 AS ret, round(next_ret, 6) + 0.0 AS next_ret FROM d_static", dup["static"])
    o["reverting_spikes"] = q(f"SELECT pair, agg_id, time FROM d_static WHERE abs(ret) > {C.static_pct} AND abs(ret + next_ret) < 0.3 * abs(ret)", dup["static"])
    o["static_clean"] = q("SELECT pair, agg_id, time, price FROM d_static WHERE NOT removed", dup["static"])
    o["trade_sigma"] = q("SELECT pair, agg_id, chunk_id, round(raw_sigma, 6) + 0.0 AS raw_sigma FROM d_static", dup["static"])
    o["chunk_sigma"] = q("""SELECT pair, chunk_id, round(arg_min(raw_sigma, (time, agg_id)) FILTER (raw_sigma IS NOT NULL), 6) + 0.0 AS first_sigma,
        round(median(s), 6) + 0.0 AS median_sigma FROM d_static GROUP BY ALL""", dup["static"])
    o["adaptive_clean"] = q("SELECT pair, agg_id, time, price FROM d_adaptive WHERE NOT removed", dup["adaptive"])
    o["cleaning_stats"] = q(" UNION ALL ".join(stats_row(m, f"d_{m}") for m in dup), *dup.values())
    act = "act AS (SELECT pair, chunk_id FROM chunks_dup WHERE n >= (SELECT avg(n) FROM chunks_dup))"
    chunks_dup = f"chunks_dup AS MATERIALIZED (SELECT pair, chunk_id, count(*) AS n FROM trades_dup t JOIN day_c c USING (pair) WHERE t.time // {DAY} = c.day GROUP BY pair, chunk_id)"
    raw_act = f"trades_act AS MATERIALIZED (SELECT t.* FROM trades_dup t JOIN day_c c ON t.pair = c.pair AND t.time // {DAY} = c.day SEMI JOIN act ON act.pair = t.pair AND act.chunk_id = c.chunk_id)"
    o["cleaning_stats_active"] = q(" UNION ALL ".join(stats_row(m, f"(SELECT * FROM d_{m} SEMI JOIN act USING (pair, chunk_id))").replace("trades_dup", "trades_act") for m in dup), *dup.values(), chunks_dup, act, raw_act)
    o["removed_trades"] = q(f"SELECT pair, CAST(time // {DAY} AS INT) AS day, count(*) AS n FROM mcl WHERE removed GROUP BY ALL", cleaned("static", "mcl", "trades", 6.0))
    o["bars_filled"] = q("SELECT * EXCLUDE (quote_vol, vwap), round(quote_vol, 6) + 0.0 AS quote_vol, round(vwap, 6) + 0.0 AS vwap FROM grid", bars_sql("", "trades"))
    o["bars_regrid"] = q("SELECT pair, chunk_id, bar_ms, close, volume, round(vwap, 6) + 0.0 AS vwap FROM grid", bars_sql("", "trades"))
    o["minute_closes"] = q("SELECT pair, bar_ms, close FROM closes", ALIGN)
    o["chunk_report"] = q("SELECT count(*) AS pairs, round(avg(n), 6) AS mean_chunks, max(n) AS max_chunks FROM (SELECT pair, count(DISTINCT chunk_id) AS n FROM chunks GROUP BY pair)")
    o["bar_features"] = q(f"SELECT pair, chunk_id, bar_ms, {feats_out()} FROM feats", base)
    o["bar_features_blocks"] = q(f"SELECT pair, bar_ms, {', '.join(rnd(x) for x in ('z_vol', 'z_ntr', 'z_ret', 'roll_sigma'))} FROM feats", base)
    o["strided_windows"] = q("SELECT pair, chunk_id, end_ms FROM win", base)
    tw = f"WINDOW w AS (PARTITION BY pair, chunk_id ORDER BY bar_ms ROWS BETWEEN {T - 1} PRECEDING AND CURRENT ROW)"
    tensor = ", ".join(
        f"round(sum(CAST({x} AS FLOAT)::DOUBLE) OVER w, 2) + 0.0 AS {x}_sum, round(sum(CAST({x} AS FLOAT)::DOUBLE * rn) OVER w - (max(rn) OVER w - {T}) * sum(CAST({x} AS FLOAT)::DOUBLE) OVER w, 1) + 0.0 AS {x}_placed"
        for x in FEATURES
    )
    o["window_tensor"] = q(f"""SELECT pair, end_ms, {T} AS t, {len(FEATURES)} AS f, {', '.join(f'{x}_sum, {x}_placed' for x in FEATURES)}
        FROM (SELECT pair, chunk_id, bar_ms AS end_ms, {tensor} FROM (SELECT *, row_number() OVER (PARTITION BY pair, chunk_id ORDER BY bar_ms) AS rn FROM feats) {tw})
        JOIN win USING (pair, chunk_id, end_ms)""", base)
    o["window_labels"] = q("SELECT pair, end_ms, y, mask FROM lab", base)
    o["split_bounds"] = q("SELECT round(t1, 3) + 0.0 AS t1, round(t2, 3) + 0.0 AS t2 FROM bounds", base)
    o["window_splits"] = q('SELECT pair, end_ms, y, split FROM allw', base)
    o["straddling_windows"] = q(f"""SELECT CAST(sum(CASE WHEN end_ms - {(T - 1) * BAR} <= t1 AND end_ms > t1 THEN 1 ELSE 0 END) AS BIGINT) AS over_t1,
        CAST(sum(CASE WHEN end_ms - {(T - 1) * BAR} <= t2 AND end_ms > t2 THEN 1 ELSE 0 END) AS BIGINT) AS over_t2 FROM allw, bounds""", base)
    o["negatives_sampled"] = q("SELECT pair, end_ms, y, split FROM ds", base)
    o["scaler_fit"] = q("SELECT feature, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std FROM scaler", full, SCALER)
    o["pretrain_pool"] = q("SELECT pair, end_ms FROM ds WHERE split = 'train' AND y = 0", base)
    o["split_report"] = q("SELECT split, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos, round(100.0 * avg(y), 2) AS pct, sum(y) = 0 AS no_positives FROM ds GROUP BY split", base)
    o["event_groups"] = q('SELECT pair, end_ms, y, split, coalesce(event_id, -1) AS event_id FROM allw LEFT JOIN ev USING (pair, end_ms)', base, events_of('allw'))
    o["events_sampled"] = q("SELECT pair, end_ms, y, split FROM sh", base, events_of('allw'), 'thin AS (SELECT pair, end_ms, y, split FROM allw)',
        "runs AS (SELECT 0.5::DOUBLE AS label_frac, 7 AS seed)", shares("thin", "ev", "runs", "sh"))
    o["labels_merged"] = q(f"""SELECT pair, min(pump_ms) AS pump_ms, string_agg(grp, '|' ORDER BY pump_ms, grp) AS grp, 'synthetic' AS source, CAST(count(*) AS INT) AS merged
        FROM (SELECT *, sum(new) OVER (PARTITION BY pair ORDER BY pump_ms, grp) AS ch FROM (SELECT *, CASE WHEN pump_ms - lag(pump_ms) OVER
          (PARTITION BY pair ORDER BY pump_ms, grp) < {30 * MINUTE} THEN 0 ELSE 1 END AS new FROM near_labels)) GROUP BY pair, ch""")
    ds_cols = ", ".join(rnd(x) for x in ("max_z_ret", "max_z_vol", "vpin"))
    for m in ("none", "static", "adaptive"):
        o[f"dataset_{m}"] = q(f"SELECT pair, end_ms, y, split, '{m}' AS mode, {ds_cols} FROM ds", chain(mode=m))
    o["labels_with_data"] = q("SELECT * FROM pumps WHERE pair IN (SELECT pair FROM chunks WHERE chunk_trades >= 700)")
    o["event_detection"] = q("SELECT tag, pair, pump_ms, detected FROM m_h", EVAL)
    o["window_stats"] = q(f"SELECT pair, end_ms, {', '.join(rnd(x) for x in STATS)} FROM win", full)
    impact = ", ".join(f"round(ln(1 + {x}), 6) + 0.0 AS {x}" for x in MICRO[4:])
    o["microstructure"] = q(f"SELECT pair, end_ms, {', '.join(rnd(x) for x in MICRO[:4])}, {impact} FROM win", base)
    o["rule_scores"] = q("SELECT pair, end_ms, round(least(max_z_ret - 2.0, max_z_vol - 2.0), 6) + 0.0 AS score FROM win", base)
    o["rush_order_scores"] = q(f"SELECT pair, end_ms, {rnd('rush_order')} FROM win", base)
    o["rule_grid"] = q("SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, tp, fp, fn, round(f1, 6) + 0.0 AS f1 FROM rf1", base, RULE.format(src="ds"))
    o["rule_fit"] = q("SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, round(f1, 6) + 0.0 AS f1 FROM rbest", base, RULE.format(src="ds"))
    o["class_weights"] = q("""SELECT y, n, round(sum(n) OVER () / (2 * n), 6) + 0.0 AS weight,
        round(sum(CASE WHEN y = 0 THEN n END) OVER () / greatest(sum(CASE WHEN y = 1 THEN n END) OVER (), 1), 6) + 0.0 AS pos_weight
        FROM (SELECT y, count(*) AS n FROM ds WHERE split = 'train' GROUP BY y)""", base)
    o["file_manifest"] = q(f"""SELECT 'tape' AS grp, length(v) AS size, sha256(v) AS sha256
        FROM (SELECT string_agg(agg_id, chr(10) ORDER BY agg_id) || chr(10) AS v FROM trades GROUP BY pair, time // {DAY}, agg_id % 2)""")
    o["score_separation"] = q("""SELECT tag, round(p, 6) + 0.0 AS pos_mean, round(n, 6) + 0.0 AS neg_mean, p > n AS separates FROM
        (SELECT tag, avg(CASE WHEN y = 1 THEN score END) AS p, avg(CASE WHEN y = 0 THEN score END) AS n FROM scored WHERE split = 'val' GROUP BY tag)""", base, scored())
    o["batch_scoring"] = q('SELECT pair, end_ms, round(1 / (1 + exp(-(0.5 * max_z_ret + 0.25 * max_z_vol))), 6) + 0.0 AS score FROM allw', base)
    o["threshold_tuning"] = q("SELECT tag, round(thr, 6) + 0.0 AS thr, round(f1, 6) + 0.0 AS f1 FROM best", EVAL)
    o["window_metrics"] = q("SELECT * FROM m_w", EVAL)
    o["ranking_metrics"] = q("SELECT * FROM m_k", base, scored('allw'), "sp AS (SELECT *, 0 AS pred FROM scored)", metrics("sp", "tag, split", 1))
    o["event_metrics"] = q("SELECT * FROM m_e", EVAL)
    o["bootstrap_ci"] = q("SELECT * FROM m_b", EVAL)
    o["full_evaluation"] = q("""SELECT * FROM m_w JOIN m_k USING (tag) JOIN m_e USING (tag) JOIN m_b USING (tag)
        JOIN (SELECT tag, round(thr, 6) AS thr, round(f1, 4) AS val_f1 FROM best) USING (tag)""", EVAL)
    ad = chain("ad_", "adaptive")
    o["ks_features"] = q("SELECT feature, n1, n2, round(statistic, 6) + 0.0 AS statistic, round(p_value, 6) + 0.0 AS p_value FROM ks", base, ad, ks_sql())
    o["label_alignment"] = q("SELECT pair, pump_ms, status, CASE WHEN status IN ('ALIGNED', 'WEAK') THEN round(spike, 6) END AS spike_pct FROM align", ALIGN)
    o["alignment_gate"] = q("""SELECT a AS aligned, u AS usable, u > 0 AND a >= 0.7 * u AS passed FROM (SELECT CAST(sum(CASE WHEN status = 'ALIGNED' THEN 1 ELSE 0 END) AS BIGINT) AS a,
        CAST(sum(CASE WHEN status IN ('ALIGNED', 'WEAK') THEN 1 ELSE 0 END) AS BIGINT) AS u FROM align)""", ALIGN)
    o["cleaning_gate"] = q("""SELECT mode, ticks_in, removed, removed_pct, round(pf, 6) AS pump_frac, round(nf, 6) AS normal_frac, round(pf / (nf + 1e-9), 6) AS ratio,
          round(k, 6) AS ks, removed_pct >= 0.3 OR pf < nf * 0.5 OR coalesce(k > 0.05, false) AS passed
        FROM (SELECT *, removed_in_pump / greatest(removed, 1) AS pf, removed_in_normal / greatest(removed, 1) AS nf,
          CASE WHEN mode = 'adaptive' THEN (SELECT max(statistic) FROM ks) END AS k FROM cs)""",
        base, ad, ks_sql(), dup["static"], dup["adaptive"],
        "cs AS (" + stats_row("static", "d_static") + " UNION ALL " + stats_row("adaptive", "d_adaptive") + ")")
    one = lambda t: f"FROM based WHERE base = '{t}'"
    o["seed_gate"] = q(f"""SELECT n_candidate, round(a, 6) AS candidate_mean, round(sa, 6) AS candidate_std, n_control, round(b, 6) AS control_mean,
          round(sb, 6) AS control_std, round(hi, 6) AS control_hi, least(n_candidate, n_control) < 3 AS provisional,
          CASE WHEN n_candidate = 0 OR n_control = 0 THEN 'MISSING' WHEN round(a, 12) > round(b, 12) AND round(a, 12) > round(hi, 12) THEN 'PASS'
               WHEN round(a, 12) > round(b, 12) THEN 'MARGINAL' ELSE 'FAIL' END AS verdict
        FROM (SELECT count(f1) AS n_candidate, avg(f1) AS a, stddev_pop(f1) AS sa {one('vpin_f50')}),
             (SELECT count(f1) AS n_control, avg(f1) AS b, stddev_pop(f1) AS sb, avg(f1_hi) AS hi {one('b2_rushorder_f50')})""", RESULTS)
    names = [("B1", "b1_rule"), ("B2", "b2_rushorder"), ("B3", "b3_microstructure"), ("B4", "b4_randomforest"), ("B5", "b5_logreg"), ("B6", "b6_xgboost"),
             ("B7", "b7_lstmae"), ("B8", "cnnbilstm_scratch"), ("B9", "at_scratch"), ("B10", "b10_at_unsup"), ("D", "at_pre")]
    vals = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(names))
    o["method_table"] = q(f"SELECT ord, method, method_tag, {', '.join(REPORT)} FROM (VALUES {vals}) t(ord, method, method_tag) LEFT JOIN newest ON base = method_tag", RESULTS)
    ab = " UNION ALL ".join(f"SELECT pair, end_ms, y, split, round(rush_order, 6) + 0.0 AS score, '{m}' AS mode FROM {m[:2]}_ds" for m in ("none", "static", "adaptive"))
    o["ablation_table"] = q(f"""SELECT ord, mode, {', '.join(REPORT)} FROM (VALUES (0, 'none'), (1, 'static'), (2, 'adaptive')) t(ord, mode)
          LEFT JOIN (SELECT * FROM m_w JOIN m_k USING (mode) LEFT JOIN m_e USING (mode) JOIN m_b USING (mode)) USING (mode)""",
        *[chain(f"{m[:2]}_", m) for m in ("none", "static", "adaptive")], f"abl AS MATERIALIZED ({ab})",
        tuned("(SELECT * FROM abl WHERE split = 'val')", "mode"), predicted("(SELECT * EXCLUDE split FROM abl WHERE split = 'test')", "best", "mode"), metrics("pred", "mode", 1000))
    o["label_efficiency"] = q("""SELECT model, label_frac, count(*) AS runs, round(avg(f1), 4) AS mean, round(stddev_pop(f1), 4) AS std,
        string_agg(format('{:.4f}', f1), ',' ORDER BY f1) AS vals, round(avg(event_recall), 4) AS event_recall_mean FROM results GROUP BY ALL""", RESULTS)
    o["missing_runs"] = q("SELECT model, label_frac, 3 AS seed FROM (SELECT DISTINCT model, label_frac FROM results)", RESULTS)
    o["efficiency_probe"] = q("""SELECT c AS candidate, k AS control, CASE WHEN c IS NULL OR k IS NULL THEN 'MISSING' WHEN c > k THEN 'AHEAD' ELSE 'FAIL' END AS verdict FROM
        (SELECT max(CASE WHEN model = 'vpin' THEN m END) AS c, max(CASE WHEN model = 'b1_rule' THEN m END) AS k FROM
          (SELECT model, round(avg(f1), 4) AS m FROM results WHERE label_frac = 0.25 GROUP BY model))""", RESULTS)
    o["seed_means"] = q("SELECT base, count(f1) AS runs, round(avg(f1), 6) AS mean, round(stddev_pop(f1), 6) AS std FROM based GROUP BY base", RESULTS)
    o["score_timeline"] = q(f"""SELECT pair, end_ms, y, vpin AS score FROM wide WHERE split = 'test'
        AND abs(end_ms - (SELECT min(end_ms) FROM wide WHERE split = 'test' AND y = 1)) <= {2 * HOUR}""", base, scored())
    o["label_stats"] = q("SELECT count(*) AS events, count(DISTINCT pair) AS pairs, min(pump_ms) AS first_ms, max(pump_ms) AS last_ms FROM near_labels")
    o["label_value_counts"] = q("SELECT pair, count(*) AS n FROM near_labels GROUP BY pair ORDER BY n DESC, pair LIMIT 10")
    o["exchange_counts"] = q("""SELECT exchange, count(*) AS n FROM (SELECT CASE WHEN n % 4 = 0 THEN 'other' ELSE 'binance' END AS exchange,
          unnest(CASE WHEN n % 2 = 0 THEN [1] ELSE [1, 2] END) AS c FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY pump_ms) AS n FROM pumps)) GROUP BY exchange""")
    o["price_quantiles"] = q("""SELECT pair, round(quantile_cont(price, 0.005), 6) + 0.0 AS p005, round(quantile_cont(price, 0.5), 6) + 0.0 AS p50,
        round(quantile_cont(price, 0.999), 6) + 0.0 AS p999 FROM trades GROUP BY pair""")
    o["price_moments"] = q("SELECT pair, round(avg(price), 6) + 0.0 AS mean, round(stddev_pop(price), 6) + 0.0 AS sd_pop, round(stddev_samp(price), 6) + 0.0 AS sd FROM trades GROUP BY pair")
    o["latest_bars"] = q(f"SELECT pair, bar_ms, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY bar_ms DESC) AS rn FROM bars) WHERE rn <= {C.z_window + T}", bars_sql("", "trades"))
    o["day_set_difference"] = q("""SELECT p.pair, p.day, CASE WHEN d.n IS NULL THEN 'missing' ELSE 'present' END AS state
        FROM planned p LEFT JOIN day_c d ON p.pair = d.pair AND p.day = d.day""", PLAN)
    o["bootstrap_picks"] = q(f"""SELECT pair, CAST(CAST(('0x' || substr(md5('{C.seed}|' || pair || '|' || agg_id), 1, 8)) AS UBIGINT) % 16 AS BIGINT) AS slot,
        count(*) AS n FROM trades GROUP BY ALL""")
    o["stream_dedup"] = q("SELECT pair, agg_id, price, qty, time, is_buyer_maker FROM trades")
    o["stream_bars"] = q(f"SELECT {barcols} FROM bars WHERE {CLOSED}", bars_sql("", "trades"))
    o["stream_messages"] = o["stream_bars"]
    o["stream_scores"] = q("SELECT pair, end_ms, round(score, 6) + 0.0 AS score FROM live", online)
    o["stream_alerts"] = q("""SELECT pair, 'rule' AS model, count(*) AS alerts, min(end_ms) AS first_ms, round(max(score), 4) AS top_score
        FROM live WHERE score >= 0.5 GROUP BY pair""", online)
    o["stream_lag"] = q(f"SELECT count(*) AS bars, max(bar_ms) AS newest_ms FROM bars WHERE {CLOSED}", bars_sql("", "trades"))
    late = "agg_id % 97 = 0 AND agg_id IN (SELECT event_id FROM events WHERE day(ts) <= 8)"
    o["stream_late_trades"] = q(f"""SELECT count(*) FILTER (NOT ({late})) AS kept, CAST(coalesce(sum(CASE WHEN agg_id % 50 = 0 THEN 2 ELSE 1 END) FILTER ({late}), 0) AS BIGINT) AS late
        FROM trades""")
    o["stream_sessions"] = q(f"SELECT * FROM sess WHERE last_ms + {GAP_MS + 1} <= (SELECT max(time) FROM trades) - 30000", SESSIONS)
    o["stream_throughput"] = q("SELECT (SELECT count(*) FROM trades) AS kept, (SELECT count(*) FROM events) AS read")
    return o
