"""DuckDB SQL oracles, written independently of the Spark plans.

Each function returns SQL text over the driver's views (``orders``,
``events``, …).  Fixture tables of FIXTURES.md §3 are CTEs so both engines
derive them from the same parquet files.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# fixture CTEs
# --------------------------------------------------------------------------

DAY_BARS = """day_bars AS (
  SELECT o_orderpriority AS symbol, o_orderdate AS ts,
         arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close
  FROM orders GROUP BY o_orderpriority, o_orderdate)"""

TICKS = """ticks AS (
  SELECT event_type AS symbol, ts, 10000.0 + value AS price, event_id FROM events)"""

MINUTE_BARS = TICKS + """,
minute_bars AS (
  SELECT symbol, date_trunc('minute', ts) AS ts,
         arg_min(price, ts) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, ts) AS close, count(*)::BIGINT AS n_ticks
  FROM ticks GROUP BY symbol, date_trunc('minute', ts))"""

TRADES_FX = """trades_fx AS (
  SELECT l_suppkey AS strategy, l_shipdate AS exit_ts, l_orderkey AS orderkey,
         l_linenumber AS linenumber, l_extendedprice * (l_discount - 0.05) AS pnl
  FROM lineitem)"""

CALLS_FX = """calls_fx AS (
  SELECT event_id AS call_id, event_type AS provider, user_id AS request,
         value / 1000.0 AS cost_usd,
         CAST(json_extract_string(props, '$.k') AS BIGINT) * 100 AS tokens,
         event_type <> 'error' AS success, ts AS created_at
  FROM events)"""


def w(keys: str, order: str, frame: str = "") -> str:
    return f"(PARTITION BY {keys} ORDER BY {order}{(' ' + frame) if frame else ''})"


RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def win_mean(x: str, n: int, keys: str, order: str) -> str:
    fr = f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    return (f"CASE WHEN count({x}) OVER {w(keys, order, fr)} = {n} "
            f"THEN avg({x}) OVER {w(keys, order, fr)} END")


def ma_cross_signals(src: str, keys: str, order: str, fast: int, slow: int) -> str:
    """CTEs g1..g3 ending in ``sig`` with a ``signal`` column."""
    return f"""g1 AS (
  SELECT *, coalesce({win_mean('close', fast, keys, order)} > {win_mean('close', slow, keys, order)},
                     false) AS above FROM {src}),
g2 AS (SELECT *, lag(above) OVER {w(keys, order)} AS prev_above FROM g1),
g3 AS (SELECT *, CASE WHEN above AND prev_above = false THEN 1
                      WHEN NOT above AND prev_above = true THEN -1 ELSE 0 END AS raw FROM g2),
sig AS (SELECT *, coalesce(lag(raw) OVER {w(keys, order)}, 0) AS signal FROM g3)"""


def ledger(src: str, keys: str, order: str, pv: float = 200.0, fee: float = 300.0,
           cash: float = 500000.0) -> str:
    """CTEs b1..b7 ending in ``led`` (position, equity, trade_pnl, ret, drawdown)."""
    return f"""b1 AS (SELECT *, last_value(nullif(signal, 0) IGNORE NULLS) OVER {w(keys, order, RUN)} AS position
  FROM {src}),
b2 AS (SELECT *, lag(position) OVER {w(keys, order)} AS position_prev,
              lag(close) OVER {w(keys, order)} AS px_prev FROM b1),
b3 AS (SELECT *, position IS NOT NULL AND (position_prev IS NULL OR position <> position_prev) AS chg
  FROM b2),
b4 AS (SELECT *, chg AND position_prev IS NOT NULL AS cls,
  last_value(CASE WHEN chg THEN close END IGNORE NULLS) OVER {w(keys, order, RUN)} AS entry_price,
  sum(chg::INT) OVER {w(keys, order, RUN)} AS ne,
  sum((chg AND position_prev IS NOT NULL)::INT) OVER {w(keys, order, RUN)} AS nc,
  sum(coalesce(position_prev * (close - px_prev), 0)) OVER {w(keys, order, RUN)} AS mtm FROM b3),
b5 AS (SELECT *, {cash} + {pv} * mtm - {fee} * ne - {2 * fee} * nc AS equity,
  CASE WHEN cls THEN (close - lag(entry_price) OVER {w(keys, order)}) * position_prev * {pv} - {2 * fee}
  END AS trade_pnl, lag(entry_price) OVER {w(keys, order)} AS entry_prev FROM b4),
b6 AS (SELECT *, equity / lag(equity) OVER {w(keys, order)} - 1 AS ret,
  max(equity) OVER {w(keys, order, RUN)} AS peak FROM b5),
led AS (SELECT *, (equity - peak) / peak AS drawdown FROM b6)"""


def metrics(src: str, keys: str, order: str, ts: str = "ts", rf: float = 0.015,
            cash: float = 500000.0) -> str:
    """CTEs ending in ``met`` with the D8 measures."""
    secs = f"((epoch_us(t1) - epoch_us(t0)) / 1e6)"
    return f"""eqs AS (
  SELECT {keys}, count(*) AS n_bars, min({ts}) AS t0, max({ts}) AS t1,
         arg_min(equity, {order}) AS e0, arg_max(equity, {order}) AS final_equity,
         avg(ret) AS mr, stddev_samp(ret) AS sr, min(drawdown) AS mdd
  FROM {src} GROUP BY {keys}),
eqm AS (
  SELECT *, CASE WHEN n_bars < 2 THEN 245.0 ELSE 31557600.0 / ({secs} / (n_bars - 1)) END AS freq,
         floor({secs} / 86400) / 365.25 AS years FROM eqs),
trs AS (
  SELECT {keys}, count(*) AS total_trades,
         sum(CASE WHEN trade_pnl > 0 THEN trade_pnl END) AS gp,
         sum(CASE WHEN trade_pnl < 0 THEN trade_pnl END) AS gl,
         count(CASE WHEN trade_pnl > 0 THEN 1 END) AS nw,
         avg(CASE WHEN trade_pnl > 0 THEN trade_pnl END) AS aw,
         avg(CASE WHEN trade_pnl < 0 THEN trade_pnl END) AS al
  FROM {src} WHERE trade_pnl IS NOT NULL GROUP BY {keys}),
met AS (
  SELECT e.{keys},
    CASE WHEN sr IS NULL THEN NULL WHEN sr = 0 THEN 0.0
         ELSE (mr - {rf} / freq) / sr * sqrt(freq) END AS sharpe,
    abs(coalesce(mdd, 0.0)) AS max_drawdown,
    CASE WHEN abs(coalesce(gl, 0)) = 0 THEN (CASE WHEN coalesce(gp, 0) > 0 THEN 'inf'::DOUBLE ELSE 0.0 END)
         ELSE coalesce(gp, 0) / abs(gl) END AS profit_factor,
    coalesce(nw / total_trades, 0.0) AS win_rate,
    coalesce(total_trades, 0)::BIGINT AS total_trades,
    CASE WHEN n_bars < 2 OR e0 = 0 THEN 0.0 WHEN years <= 0 THEN 0.0
         WHEN final_equity / e0 < 0 THEN NULL
         ELSE pow(final_equity / e0, 1.0 / years) - 1 END AS annual_return,
    coalesce(aw, 0.0) AS avg_win, coalesce(al, 0.0) AS avg_loss,
    coalesce(final_equity, {cash}) AS final_equity, n_bars
  FROM eqm e LEFT JOIN trs t ON e.{keys} = t.{keys})"""


def screen_select(src: str = "met") -> str:
    reasons = """list_filter([
      CASE WHEN sharpe < 1.2 THEN printf('Sharpe %.2f < 1.2', sharpe) END,
      CASE WHEN max_drawdown > 0.35 THEN printf('MaxDD %.1f%% > 35%%', max_drawdown * 100) END,
      CASE WHEN profit_factor < 1.0 THEN printf('PF %.2f < 1.0', profit_factor) END,
      CASE WHEN total_trades < 80 THEN printf('Trades %d < 80', total_trades) END], lambda x: x IS NOT NULL)"""
    return f"""SELECT *, array_to_string({reasons}, '; ') AS reasons, len({reasons}) = 0 AS passed
FROM {src}"""


MONEY = ("final_equity", "avg_win", "avg_loss")


def rounded(sql: str, cols: list[str], digits: int = 6) -> str:
    """Wrap a query, rounding the named double columns (money to cents)."""
    rep = ", ".join(f"round({c}, {min(digits, 2) if c in MONEY else digits}) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) q"


METRIC_DOUBLES = ["sharpe", "max_drawdown", "profit_factor", "win_rate", "annual_return",
                  "avg_win", "avg_loss", "final_equity"]


def ma_cross_backtest_metrics() -> str:
    body = f"""WITH {DAY_BARS},
{ma_cross_signals('day_bars', 'symbol', 'ts', 20, 60)},
{ledger('sig', 'symbol', 'ts')},
{metrics('led', 'symbol', 'ts')}
{screen_select('met')}"""
    return rounded(body, METRIC_DOUBLES)


# --------------------------------------------------------------------------
# bars, sessions, quality
# --------------------------------------------------------------------------

def sod(ts: str = "ts") -> str:
    """Seconds of day incl. the fraction."""
    return f"(hour({ts}) * 3600 + minute({ts}) * 60 + microsecond({ts}) / 1e6)"


def bin_expr(tf: str, ts: str = "ts", origin: str | None = None) -> str:
    if tf == "D":
        return f"CAST(CAST({ts} AS DATE) AS TIMESTAMP)"
    if tf == "W":
        return f"CAST(CAST({ts} AS DATE) - CAST(dayofweek({ts}) AS INTEGER) AS TIMESTAMP)"
    n = int(tf.replace("min", ""))
    base = origin or f"CAST(CAST({ts} AS DATE) AS TIMESTAMP)"
    return (f"{base} + to_minutes(CAST(floor((epoch_us({ts}) - epoch_us({base})) / {n * 60_000_000}) "
            f"AS BIGINT) * {n})")


RES_COLS = ["open", "high", "low", "close"]


def minute_bars_q() -> str:
    return rounded(f"WITH {MINUTE_BARS} SELECT * FROM minute_bars", RES_COLS)


def resample_q(tf: str) -> str:
    n = tf.replace("min", "")
    if n.isdigit() and 1440 % int(n) != 0:
        src = ("(SELECT *, CAST(CAST(min(ts) OVER (PARTITION BY symbol) AS DATE) AS TIMESTAMP) AS origin "
               "FROM minute_bars)")
        b = bin_expr(tf, "ts", "origin")
    else:
        src, b = "minute_bars", bin_expr(tf)
    sql = f"""WITH {MINUTE_BARS}
SELECT symbol, {b} AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
       arg_max(close, ts) AS close
FROM {src} GROUP BY symbol, {b}"""
    return rounded(sql, RES_COLS)


def _is_day(ts="ts", inclusive=True):
    s = sod(ts)
    return f"({s} >= 31500 AND {s} {'<=' if inclusive else '<'} 49500)"


def _is_night(ts="ts", inclusive=True):
    s = sod(ts)
    if inclusive:
        return f"(({s} >= 54000 AND {s} <= 86399) OR {s} <= 18000)"
    return f"({s} >= 54000 OR {s} < 18000)"


def _classify(ts="ts"):
    return (f"CASE WHEN {_is_day(ts)} THEN 'day_session' WHEN {_is_night(ts)} THEN 'night_session' "
            f"ELSE 'non_trading' END")


def session_classify_q() -> str:
    s = sod("ts")
    return f"""WITH {TICKS}
SELECT event_id, symbol, ts, {_classify()} AS session_type,
  {_is_day('ts', False)} AS in_day_slice, {_is_night('ts', False)} AS in_night_slice,
  ({s} >= 31500 AND {s} < 48300) AS open_daytrade_day, {s} = 49140 AS close_daytrade_day,
  (({s} >= 54000 AND {s} <= 86399) OR {s} < 15900) AS open_daytrade_night,
  {s} = 17040 AS close_daytrade_night,
  ({s} >= 31500 AND {s} <= 49500) AS open_swing_day, false AS close_swing_day,
  ({_classify()} <> 'non_trading') AS open_swing_full, false AS close_swing_full
FROM ticks"""


def session_slice_day_q() -> str:
    return rounded(f"WITH {MINUTE_BARS} SELECT * FROM minute_bars WHERE {_is_day('ts', False)}",
                   RES_COLS)


def trading_sessions_q() -> str:
    return rounded(f"WITH {TICKS} SELECT * FROM ticks WHERE {_is_day('ts', False)} OR "
                   f"{_is_night('ts', False)}", ["price"])


DATE_DIM = f"""dd0 AS (
  SELECT symbol, CAST(ts AS DATE) AS date, bool_or({_is_day()}) AS has_day
  FROM ticks GROUP BY symbol, CAST(ts AS DATE)),
dd AS (
  SELECT *, min(CASE WHEN has_day THEN date END) OVER (PARTITION BY symbol ORDER BY date
         ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_day FROM dd0)"""


def next_trading_day_q() -> str:
    return f"WITH {TICKS}, {DATE_DIM} SELECT * FROM dd"


def trading_day_assign_q() -> str:
    s = sod("ts")
    return f"""WITH {TICKS}, {DATE_DIM}
SELECT t.event_id, t.symbol, t.ts,
  CASE WHEN {_is_day('t.ts')} THEN CAST(t.ts AS DATE)
       WHEN {s.replace('ts', 't.ts')} >= 54000 AND {s.replace('ts', 't.ts')} <= 86399 THEN d.next_day
       WHEN {s.replace('ts', 't.ts')} <= 18000 THEN
         CASE WHEN d.has_day THEN CAST(t.ts AS DATE) ELSE coalesce(d.next_day, CAST(t.ts AS DATE)) END
  END AS trading_day,
  {_classify('t.ts')} AS session_type
FROM ticks t LEFT JOIN dd d ON d.symbol = t.symbol AND d.date = CAST(t.ts AS DATE)"""


FLAGGED = f"""{MINUTE_BARS},
fl0 AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS prev_close,
               lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS prev_ts FROM minute_bars),
fl AS (SELECT *, (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL) AS is_null,
  (coalesce(high < low, false) OR coalesce(open <= 0, false) OR coalesce(close <= 0, false)) AS is_ohlc_error,
  coalesce(abs(open - prev_close) / CASE WHEN prev_close <> 0 THEN prev_close END > 0.05, false) AS is_jump,
  (epoch_us(ts) - epoch_us(prev_ts)) / 60e6 AS gap_min
  FROM fl0),
flagged AS (SELECT *, is_null OR is_ohlc_error OR is_jump AS is_anomaly,
  CASE WHEN {_is_day('prev_ts', False)} AND {_is_day('ts', False)}
             AND CAST(ts AS DATE) - CAST(prev_ts AS DATE) = 0 THEN 'day'
       WHEN {_is_night('prev_ts', False)} AND {_is_night('ts', False)}
             AND CAST(ts AS DATE) - CAST(prev_ts AS DATE) <= 1 THEN 'night'
       ELSE 'cross-session' END AS gap_session
  FROM fl)"""


def bar_flags_q() -> str:
    return rounded(f"""WITH {FLAGGED}
SELECT symbol, ts, prev_close, is_null, is_ohlc_error, is_jump, is_anomaly FROM flagged""",
                   ["prev_close"])


def bar_gaps_q() -> str:
    return rounded(f"""WITH {FLAGGED}
SELECT symbol, prev_ts AS gap_start, ts AS gap_end, gap_min AS gap_minutes, gap_session AS session
FROM flagged WHERE prev_ts IS NOT NULL AND gap_min > 5 AND gap_session <> 'cross-session'""",
                   ["gap_minutes"])


def bar_quality_report_q() -> str:
    return rounded(f"""WITH {FLAGGED}
SELECT symbol, count(*) AS total_bars, count_if(is_null) AS null_count,
  count_if(is_ohlc_error) AS ohlc_error_count, count_if(is_jump) AS price_jump_count,
  count_if(is_anomaly) AS anomaly_count,
  count_if(prev_ts IS NOT NULL AND gap_min > 5 AND gap_session <> 'cross-session') AS gap_count,
  min(ts) AS first_ts, max(ts) AS last_ts,
  count(*) - count_if(is_anomaly) AS valid_bars,
  count_if(is_null) / count(*) AS null_rate, count_if(is_anomaly) / count(*) AS anomaly_rate
FROM flagged GROUP BY symbol""", ["null_rate", "anomaly_rate"])


def symbol_summary_q() -> str:
    return f"""WITH {MINUTE_BARS}
SELECT symbol, count(*) AS bar_count, min(ts) AS first_ts, max(ts) AS last_ts
FROM minute_bars GROUP BY symbol"""


def bars_between_q() -> str:
    return rounded(f"""WITH {DAY_BARS}
SELECT * FROM day_bars WHERE symbol = '1-URGENT' AND ts >= TIMESTAMP '1996-01-01'
  AND ts <= TIMESTAMP '1996-12-31 23:59:59'""", RES_COLS)


# --------------------------------------------------------------------------
# indicators and signals on daily bars (recursive CTEs)
# --------------------------------------------------------------------------

def _d(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def rec_cte(name: str, src: str, states: list[tuple[str, str, str]]) -> str:
    """Row-by-row recursion per symbol over ``rn``; ``s.`` is the current row,
    ``r.`` the previous state."""
    init = ", ".join(f"{i} AS {c}" for c, i, _ in states)
    step = ", ".join(f"{st} AS {c}" for c, _, st in states)
    return f"""{name} AS (
  SELECT s.symbol, s.rn, {init} FROM {src} s WHERE s.rn = 0
  UNION ALL
  SELECT s.symbol, s.rn, {step} FROM {name} r JOIN {src} s ON s.symbol = r.symbol AND s.rn = r.rn + 1)"""


def ema_states(col: str, x: str, n: int, seed: str, alpha: float | None = None):
    a = alpha if alpha is not None else 2.0 / (n + 1)
    init = f"CAST(CASE WHEN s.rn = {n - 1} THEN s.{seed} END AS DOUBLE)"
    step = (f"CASE WHEN s.rn < {n - 1} THEN NULL WHEN s.rn = {n - 1} THEN s.{seed} "
            f"ELSE {_d(1.0 - a)} * r.{col} + {_d(a)} * s.{x} END")
    return [(col, init, step)]


def ewm_states(col: str, x: str, alpha: float):
    a = _d(1.0 - alpha)
    v = f"CAST(CASE WHEN s.{x} IS NULL THEN 0.0 ELSE 1.0 END AS DOUBLE)"
    k = f"CAST(CASE WHEN s.{x} IS NULL THEN 0 ELSE 1 END AS BIGINT)"
    return [(f"{col}_n", f"CAST(coalesce(s.{x}, 0.0) AS DOUBLE)", f"{a} * r.{col}_n + coalesce(s.{x}, 0.0)"),
            (f"{col}_d", v, f"{a} * r.{col}_d + {v}"),
            (f"{col}_k", k, f"r.{col}_k + {k}")]


def ewm_value(col: str, mp: int) -> str:
    return f"CASE WHEN {col}_k >= {mp} THEN {col}_n / {col}_d END"


def _seed(x: str, n: int, order: str = "rn") -> str:
    fr = f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    return (f"CASE WHEN count({x}) OVER (PARTITION BY symbol ORDER BY {order} {fr}) = {n} "
            f"THEN avg({x}) OVER (PARTITION BY symbol ORDER BY {order} {fr}) END")


def ind_sql(emas=(), macd=None, rsi=(), atr=(), adx=()) -> str:
    """CTEs ending in ``ind``: day bars with rn and the requested indicators:
    ``ema_<n>``, ``macd``/``macd_signal``/``macd_hist``, ``rsi_<n>`` (ratio
    form) and ``rsis_<n>`` (share form), ``atr_<n>``, ``adx_<n>``/``dmp_<n>``/``dmn_<n>``."""
    emas = sorted(set(emas) | (set(macd[:2]) if macd else set()))
    W = "(PARTITION BY symbol ORDER BY ts)"
    seeds = "".join(f",\n    {_seed('close', n, 'ts')} AS seed_{n}" for n in emas)
    ctes = [DAY_BARS, f"""s0 AS (
  SELECT *, row_number() OVER {W} - 1 AS rn, lag(close) OVER {W} AS pc, lag(high) OVER {W} AS ph,
    lag(low) OVER {W} AS pl{seeds} FROM day_bars)""", """s1 AS (
  SELECT *, CASE WHEN close - pc IS NULL THEN NULL ELSE greatest(close - pc, 0.0) END AS gain,
    CASE WHEN close - pc IS NULL THEN NULL ELSE greatest(pc - close, 0.0) END AS loss,
    CASE WHEN pc IS NULL THEN NULL ELSE greatest(high - low, abs(high - pc), abs(pc - low)) END AS tr,
    CASE WHEN high - ph IS NULL OR pl - low IS NULL THEN NULL
         WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0.0 END AS pdm,
    CASE WHEN high - ph IS NULL OR pl - low IS NULL THEN NULL
         WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0.0 END AS ndm
  FROM s0)"""]
    st = []
    for n in emas:
        st += ema_states(f"ema_{n}", "close", n, f"seed_{n}")
    for n in rsi:
        st += ewm_states(f"g{n}", "gain", 1.0 / n) + ewm_states(f"l{n}", "loss", 1.0 / n)
    for n in set(atr) | set(adx):
        st += ewm_states(f"t{n}", "tr", 1.0 / n)
    for n in adx:
        st += ewm_states(f"p{n}", "pdm", 1.0 / n) + ewm_states(f"m{n}", "ndm", 1.0 / n)
    cols = ["s.*"]
    if st:
        ctes.append(rec_cte("r1", "s1", st))
    for n in emas:
        cols.append(f"r1.ema_{n}")
    for n in rsi:
        g, lo = ewm_value(f"r1.g{n}", n), ewm_value(f"r1.l{n}", n)
        cols.append(f"100.0 - 100.0 / (1.0 + ({g}) / nullif({lo}, 0.0)) AS rsi_{n}")
        cols.append(f"100.0 * (({g}) / (({g}) + ({lo}))) AS rsis_{n}")
    for n in set(atr) | set(adx):
        cols.append(f"{ewm_value(f'r1.t{n}', n)} AS atr_{n}")
    for n in adx:
        cols.append(f"{ewm_value(f'r1.p{n}', n)} AS mp_{n}")
        cols.append(f"{ewm_value(f'r1.m{n}', n)} AS mn_{n}")
    join = " JOIN r1 ON r1.symbol = s.symbol AND r1.rn = s.rn" if st else ""
    ctes.append(f"i1 AS (SELECT {', '.join(cols)} FROM s1 s{join})")
    last = "i1"
    if adx:
        exprs = []
        for n in adx:
            exprs.append(f"(100.0 / atr_{n}) * mp_{n} AS dmp_{n}, (100.0 / atr_{n}) * mn_{n} AS dmn_{n}")
        ctes.append(f"i2 AS (SELECT *, {', '.join(exprs)} FROM {last})")
        exprs = [f"100.0 * (abs(dmp_{n} - dmn_{n}) / (dmp_{n} + dmn_{n})) AS dx_{n}" for n in adx]
        ctes.append(f"i3 AS (SELECT *, {', '.join(exprs)} FROM i2)")
        st3 = []
        for n in adx:
            st3 += ewm_states(f"x{n}", f"dx_{n}", 1.0 / n)
        ctes.append(rec_cte("r3", "i3", st3))
        av = ", ".join(f"{ewm_value(f'r3.x{n}', n)} AS adx_{n}" for n in adx)
        ctes.append(f"i4 AS (SELECT i3.*, {av} FROM i3 JOIN r3 ON r3.symbol = i3.symbol AND r3.rn = i3.rn)")
        last = "i4"
    if macd:
        f, s, g = macd
        first = max(f, s) - 1
        ctes.append(f"""m0 AS (
  SELECT symbol, rn - {first} AS rn, ema_{f} - ema_{s} AS macd FROM {last} WHERE rn >= {first})""")
        ctes.append(f"m1 AS (SELECT *, {_seed('macd', g)} AS seed_m FROM m0)")
        ctes.append(rec_cte("r2", "m1", ema_states("macd_signal", "macd", g, "seed_m")))
        ctes.append(f"""i5 AS (
  SELECT x.*, x.ema_{f} - x.ema_{s} AS macd, r2.macd_signal,
         (x.ema_{f} - x.ema_{s}) - r2.macd_signal AS macd_hist
  FROM {last} x LEFT JOIN r2 ON r2.symbol = x.symbol AND r2.rn = x.rn - {first})""")
        last = "i5"
    ctes.append(f"ind AS (SELECT * FROM {last})")
    return "WITH RECURSIVE " + ",\n".join(ctes)


def ema_12_q() -> str:
    return rounded(f"{ind_sql(emas=[12])}\nSELECT symbol, ts, ema_12 FROM ind", ["ema_12"], 4)


def macd_q() -> str:
    return rounded(f"{ind_sql(macd=(12, 26, 9))}\nSELECT symbol, ts, macd, macd_signal, macd_hist FROM ind",
                   ["macd", "macd_signal", "macd_hist"], 4)


def rsi_q() -> str:
    return rounded(f"{ind_sql(rsi=[14])}\nSELECT symbol, ts, rsi_14 AS rsi, rsis_14 AS rsi_wilder FROM ind",
                   ["rsi", "rsi_wilder"], 6)


def atr_q() -> str:
    return rounded(f"{ind_sql(atr=[14])}\nSELECT symbol, ts, atr_14 AS atr FROM ind", ["atr"], 4)


def adx_q() -> str:
    return rounded(f"{ind_sql(adx=[14])}\nSELECT symbol, ts, adx_14 AS adx, dmp_14 AS dmp, dmn_14 AS dmn FROM ind",
                   ["adx", "dmp", "dmn"], 6)


def bollinger_q() -> str:
    fr = "ROWS BETWEEN 19 PRECEDING AND CURRENT ROW"
    w_ = f"(PARTITION BY symbol ORDER BY ts {fr})"
    return rounded(f"""WITH {DAY_BARS}, b AS (
  SELECT symbol, ts, CASE WHEN count(close) OVER {w_} = 20 THEN avg(close) OVER {w_} END AS m,
         CASE WHEN count(close) OVER {w_} = 20 THEN stddev_pop(close) OVER {w_} END AS sd,
         CASE WHEN count(high) OVER {w_} = 20 THEN max(high) OVER {w_} END AS highest_20,
         CASE WHEN count(low) OVER {w_} = 20 THEN min(low) OVER {w_} END AS lowest_20
  FROM day_bars)
SELECT symbol, ts, m AS bb_mid, m + 2.0 * sd AS bb_upper, m - 2.0 * sd AS bb_lower, highest_20, lowest_20
FROM b""", ["bb_mid", "bb_upper", "bb_lower", "highest_20", "lowest_20"], 4)


WO = "(PARTITION BY symbol ORDER BY rn)"


def _vcross(a: str, b: str) -> tuple[str, str]:
    up = f"coalesce({a} > {b} AND lag({a}) OVER {WO} <= lag({b}) OVER {WO}, false)"
    dn = f"coalesce({a} < {b} AND lag({a}) OVER {WO} >= lag({b}) OVER {WO}, false)"
    return up, dn


def _gt(a: str, b: str) -> str:
    return f"coalesce({a} > {b}, false)"


def _sig(long_: str, short: str) -> str:
    return f"CASE WHEN {long_} THEN 1 WHEN {short} THEN -1 ELSE 0 END"


def _delay(src: str) -> str:
    return f"""SELECT symbol, ts, CAST(coalesce(lag(raw) OVER {WO}, 0) AS INTEGER) AS signal FROM {src}"""


def sig_ma_cross_q() -> str:
    return f"""WITH {DAY_BARS},
{ma_cross_signals('day_bars', 'symbol', 'ts', 20, 60)}
SELECT symbol, ts, CAST(signal AS INTEGER) AS signal FROM sig"""


def sig_rsi_reversal_q() -> str:
    st = [("st", "CAST(CASE WHEN s.rsi_14 IS NULL THEN 0 WHEN s.rsi_14 < 30 THEN 1 WHEN s.rsi_14 > 70 THEN -1 ELSE 0 END AS INTEGER)",
           """CASE WHEN s.rsi_14 IS NULL THEN r.st
                WHEN r.st = 0 THEN (CASE WHEN s.rsi_14 < 30 THEN 1 WHEN s.rsi_14 > 70 THEN -1 ELSE 0 END)
                WHEN r.st = 1 THEN (CASE WHEN s.rsi_14 >= 50 THEN 0 ELSE 1 END)
                ELSE (CASE WHEN s.rsi_14 <= 50 THEN 0 ELSE -1 END) END""")]
    return f"""{ind_sql(rsi=[14])},
{rec_cte('q', 'ind', st)},
a AS (SELECT i.symbol, i.ts, i.rn, CASE WHEN i.rsi_14 IS NULL THEN 0 ELSE q.st END AS state
      FROM ind i JOIN q ON q.symbol = i.symbol AND q.rn = i.rn),
b AS (SELECT *, coalesce(sign(state - lag(state) OVER {WO}), 0) AS raw FROM a)
{_delay('b')}"""


def sig_dual_ema_cross_q() -> str:
    up, dn = _vcross("ema_12", "ema_26")
    w12 = "ROWS BETWEEN 11 PRECEDING AND CURRENT ROW"
    atr_ma = (f"CASE WHEN count(atr_14) OVER (PARTITION BY symbol ORDER BY rn {w12}) = 12 "
              f"THEN avg(atr_14) OVER (PARTITION BY symbol ORDER BY rn {w12}) END")
    vol = _gt("atr_14", f"1.2 * ({atr_ma})")
    return f"""{ind_sql(emas=[12, 26], atr=[14])},
b AS (SELECT *, {_sig(f'{up} AND {vol}', f'{dn} AND {vol}')} AS raw FROM ind)
{_delay('b')}"""


def sig_dual_ema_atr_trend_q() -> str:
    tu, ok = _gt("ema_18", "ema_55"), _gt("adx_14", "20")
    return f"""{ind_sql(emas=[18, 55], adx=[14])},
b AS (SELECT *, {_sig(f'{tu} AND {ok}', f'NOT {tu} AND {ok}')} AS raw FROM ind)
{_delay('b')}"""


def sig_ema_adx_q() -> str:
    up, dn = _vcross("ema_9", "ema_21")
    ok = _gt("adx_14", "25")
    return f"""{ind_sql(emas=[9, 21], adx=[14])},
b AS (SELECT *, {_sig(f'{up} AND {ok}', f'{dn} AND {ok}')} AS raw FROM ind)
{_delay('b')}"""


def sig_macd_ma_trend_q() -> str:
    up, dn = _vcross("macd", "macd_signal")
    m20 = win_mean("close", 20, "symbol", "rn")
    m60 = win_mean("close", 60, "symbol", "rn")
    return f"""{ind_sql(macd=(12, 26, 9))},
b AS (SELECT *, {_sig(f'{up} AND {_gt(m20, m60)}', f'{dn} AND {_gt(m60, m20)}')} AS cross_ FROM ind),
c AS (SELECT *, coalesce(last_value(nullif(cross_, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY rn {RUN}), 0) AS raw FROM b)
{_delay('c')}"""


def sig_macd_rsi_trend_q() -> str:
    up, dn = _vcross("macd", "macd_signal")
    return f"""{ind_sql(emas=[20], macd=(12, 26, 9), rsi=[14])},
b AS (SELECT *, {_sig(f"{_gt('close', 'ema_20')} AND {up} AND {_gt('rsis_14', '50.0')}",
                      f"{_gt('ema_20', 'close')} AND {dn} AND {_gt('50.0', 'rsis_14')}")} AS raw FROM ind)
{_delay('b')}"""


def sig_macd_trend_confirm_q() -> str:
    ab, be = _gt("macd", "macd_signal"), _gt("macd_signal", "macd")
    up = f"{ab} AND coalesce(lag({ab}) OVER {WO} = false, false)"
    dn = f"{be} AND coalesce(lag({be}) OVER {WO} = false, false)"
    return f"""{ind_sql(emas=[50], macd=(12, 26, 9))},
b AS (SELECT *, {_sig(f"{up} AND {_gt('close', 'ema_50')}", f"{dn} AND {_gt('ema_50', 'close')}")} AS raw FROM ind)
{_delay('b')}"""


def sig_trend_breakout_q(prior: bool = False) -> str:
    fr = "ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING" if prior else "ROWS BETWEEN 19 PRECEDING AND CURRENT ROW"
    hi = f"CASE WHEN count(high) OVER (PARTITION BY symbol ORDER BY rn {fr}) = 20 THEN max(high) OVER (PARTITION BY symbol ORDER BY rn {fr}) END"
    lo = f"CASE WHEN count(low) OVER (PARTITION BY symbol ORDER BY rn {fr}) = 20 THEN min(low) OVER (PARTITION BY symbol ORDER BY rn {fr}) END"
    return f"""{ind_sql(emas=[50], atr=[14])},
b AS (SELECT *, {_gt('close', 'ema_50')} AND {_gt('close', hi)} AS le,
         {_gt('ema_50', 'close')} AND {_gt(lo, 'close')} AS se,
         {_gt('ema_50 - 2.0 * atr_14', 'close')} AS sl, {_gt('close', 'ema_50 + 2.0 * atr_14')} AS ss,
         count(*) OVER (PARTITION BY symbol) AS n FROM ind),
c AS (SELECT *, sum(le::INT) OVER (PARTITION BY symbol ORDER BY rn {RUN}) - sum(se::INT) OVER (PARTITION BY symbol ORDER BY rn {RUN})
               - sum(sl::INT) OVER (PARTITION BY symbol ORDER BY rn {RUN}) AS inl,
               sum(se::INT) OVER (PARTITION BY symbol ORDER BY rn {RUN}) - sum(le::INT) OVER (PARTITION BY symbol ORDER BY rn {RUN})
               - sum(ss::INT) OVER (PARTITION BY symbol ORDER BY rn {RUN}) AS ins FROM b),
d AS (SELECT *, CASE WHEN (sl AND coalesce(lag(inl) OVER {WO} > 0, false))
                       OR (ss AND coalesce(lag(ins) OVER {WO} > 0, false))
                       OR (n > 30 AND rn >= n - 30) THEN 0
                     ELSE {_sig('le', 'se')} END AS raw FROM c)
{_delay('d')}"""


def sig_trend_catcher_q() -> str:
    up, dn = _vcross("ema_9", "ema_21")
    return f"""{ind_sql(emas=[9, 21], macd=(12, 26, 9))},
b AS (SELECT *, {_sig(f"{up} AND {_gt('macd_hist', '0.0')}", f"{dn} AND {_gt('0.0', 'macd_hist')}")} AS raw FROM ind)
{_delay('b')}"""


def sig_trend_filtered_ema_q() -> str:
    up, dn = _vcross("ema_9", "ema_18")
    ok = (f"{_gt('adx_14', '22')} AND {_gt('rsis_14', '30.0')} AND {_gt('70.0', 'rsis_14')} "
          f"AND atr_14 IS NOT NULL")
    ref = f"lag(close) OVER {WO}"
    dist = f"lag(atr_14) OVER {WO} * 2.0"
    return f"""{ind_sql(emas=[9, 18], adx=[14], rsi=[14], atr=[14])},
b AS (SELECT *, {_sig(f'{up} AND {ok}', f'{dn} AND {ok}')} AS s0 FROM ind),
c AS (SELECT *, CASE WHEN ({_gt(f'{ref} - {dist}', f'lead(low) OVER {WO}')} AND s0 = 1)
                       OR ({_gt(f'lead(high) OVER {WO}', f'{ref} + {dist}')} AND s0 = -1) THEN 0
                     ELSE s0 END AS raw FROM b)
{_delay('c')}"""


# --------------------------------------------------------------------------
# reports on the SMA-cross ledger and on trades_fx
# --------------------------------------------------------------------------

def _ma_ledger() -> str:
    return f"""WITH {DAY_BARS},
{ma_cross_signals('day_bars', 'symbol', 'ts', 20, 60)},
{ledger('sig', 'symbol', 'ts')}"""


MONTHLY = """m AS (SELECT symbol, CAST(date_trunc('month', ts) AS DATE) AS month, arg_max(equity, ts) AS eq
  FROM led GROUP BY 1, 2),
sp AS (SELECT symbol, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month
  FROM m GROUP BY symbol),
mx AS (SELECT sp.symbol, sp.month, m.eq FROM sp LEFT JOIN m ON m.symbol = sp.symbol AND m.month = sp.month),
my AS (SELECT *, eq - lag(eq) OVER (PARTITION BY symbol ORDER BY month) AS pnl FROM mx),
mp AS (SELECT symbol, last_day(month) AS month_end, CAST(year(month) AS INTEGER) AS year,
  CAST(month(month) AS INTEGER) AS month, pnl FROM my WHERE pnl IS NOT NULL)"""


def monthly_pnl_q() -> str:
    return f"{_ma_ledger()},\n{MONTHLY}\nSELECT symbol, month_end, year, month, round(pnl, 2) AS pnl FROM mp"


def monthly_matrix_q() -> str:
    ms = ", ".join(f"round(sum(CASE WHEN month = {i} THEN pnl END), 2) AS m{i:02d}" for i in range(1, 13))
    return f"{_ma_ledger()},\n{MONTHLY}\nSELECT symbol, year, {ms}, round(sum(pnl), 2) AS total FROM mp GROUP BY symbol, year"


def drawdown_series_q() -> str:
    return (f"{_ma_ledger()}\nSELECT symbol, ts, round(equity, 2) AS equity, round(peak, 2) AS peak, "
            f"round(drawdown, 6) AS drawdown FROM led")


def equity_daily_q() -> str:
    return (f"{_ma_ledger()}\nSELECT symbol, CAST(ts AS DATE) AS date, round(arg_max(equity, ts), 2) AS equity "
            f"FROM led GROUP BY 1, 2")


def signal_distribution_q() -> str:
    return f"""WITH {DAY_BARS},
{ma_cross_signals('day_bars', 'symbol', 'ts', 20, 60)}
SELECT symbol, count_if(signal = 1) AS n_long, count_if(signal = -1) AS n_short,
       count_if(signal = 0) AS n_flat FROM sig GROUP BY symbol"""


def trade_list_q() -> str:
    return (f"{_ma_ledger()}\nSELECT symbol, ts AS exit_ts, position_prev AS side, round(entry_prev, 2) AS entry_price, "
            f"round(close, 2) AS exit_price, round(trade_pnl, 2) AS pnl, "
            f"round(((close - entry_prev) * position_prev - 4.0) * 200.0, 2) AS pnl_flat "
            f"FROM led WHERE trade_pnl IS NOT NULL")


def trade_durations_q() -> str:
    return f"""{_ma_ledger()},
e1 AS (SELECT *, last_value(CASE WHEN chg THEN ts END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts {RUN}) AS ets FROM led),
e2 AS (SELECT *, lag(ets) OVER (PARTITION BY symbol ORDER BY ts) AS ets_prev FROM e1)
SELECT symbol,
  round(avg(CASE WHEN trade_pnl IS NOT NULL THEN floor((epoch_us(ts) - epoch_us(ets_prev)) / 60e6) END), 4) AS avg_hold_minutes,
  count_if(trade_pnl IS NOT NULL) AS n_closed, min(ts) AS data_start, max(ts) AS data_end
FROM e2 GROUP BY symbol"""


TRADE_STREAKS = f"""{TRADES_FX},
t1 AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY exit_ts, orderkey, linenumber) - 1 AS rn
  FROM trades_fx),
t2 AS (SELECT *, sum(CASE WHEN pnl < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY strategy ORDER BY rn {RUN}) AS cl FROM t1),
t3 AS (SELECT *, cl - coalesce(last_value(CASE WHEN pnl >= 0 THEN cl END IGNORE NULLS)
  OVER (PARTITION BY strategy ORDER BY rn {RUN}), 0) AS loss_streak FROM t2)"""


def loss_streaks_q() -> str:
    return (f"WITH {TRADE_STREAKS}\nSELECT strategy, exit_ts, orderkey, linenumber, round(pnl, 4) AS pnl, "
            f"loss_streak FROM t3")


def health_alerts_q() -> str:
    lvl = ("CASE WHEN loss_streak >= 10 OR dd_ratio >= 0.8 THEN 'red' WHEN loss_streak >= 8 OR dd_ratio >= 0.7 "
           "THEN 'orange' WHEN loss_streak >= 5 OR dd_ratio >= 0.5 THEN 'yellow' ELSE 'green' END")
    return f"""WITH {TRADE_STREAKS},
h1 AS (SELECT *, 500000.0 + sum(pnl) OVER (PARTITION BY strategy ORDER BY rn {RUN}) AS equity FROM t3),
h2 AS (SELECT *, max(equity) OVER (PARTITION BY strategy ORDER BY rn {RUN}) AS peak FROM h1),
h3 AS (SELECT *, (peak - equity) / peak / 0.2 AS dd_ratio FROM h2),
h4 AS (SELECT *, {lvl} AS level FROM h3),
h5 AS (SELECT *, CASE level WHEN 'red' THEN 3 WHEN 'orange' THEN 2 WHEN 'yellow' THEN 1 ELSE 0 END AS rk FROM h4)
SELECT strategy, count(*) AS n_trades, arg_max(loss_streak, rn) AS loss_streak,
  round(arg_max(dd_ratio, rn), 6) AS dd_ratio, arg_max(level, rn) AS level,
  CASE max(rk) WHEN 3 THEN 'red' WHEN 2 THEN 'orange' WHEN 1 THEN 'yellow' ELSE 'green' END AS worst_level,
  max(loss_streak) AS max_loss_streak
FROM h5 GROUP BY strategy"""


# --------------------------------------------------------------------------
# walk-forward (SMA cross, grid fast {10,20,30} x slow {40,60,80}, 24/6 months)
# --------------------------------------------------------------------------

def _wfa_core(pv: float = 200.0, fee: float = 300.0, cash: float = 500000.0) -> str:
    combos = ", ".join(f"({i}, {f}, {s})" for i, (f, s) in enumerate(
        [(f, s) for f in (10, 20, 30) for s in (40, 60, 80)]))
    K = "symbol, k, segment, combo_idx"
    smas = ",\n    ".join(f"{win_mean('close', n, 'symbol, k, segment', 'ts')} AS sma_{n}"
                         for n in (10, 20, 30, 40, 60, 80))
    fast = "CASE fast_period " + " ".join(f"WHEN {n} THEN sma_{n}" for n in (10, 20, 30)) + " END"
    slow = "CASE slow_period " + " ".join(f"WHEN {n} THEN sma_{n}" for n in (40, 60, 80)) + " END"
    secs = "((epoch_us(t1) - epoch_us(t0)) / 1e6)"
    return f"""WITH {DAY_BARS},
sp AS (SELECT symbol, min(ts) AS t0, max(ts) AS t1, CAST(date_trunc('month', min(ts)) AS DATE) AS m0
  FROM day_bars GROUP BY symbol),
k1 AS (SELECT sp.*, r.k, CAST(m0 + to_months(CAST(r.k * 6 AS INTEGER)) AS DATE) AS mk
  FROM sp CROSS JOIN range(0, 400) r(k)),
k2 AS (SELECT *, CASE WHEN k = 0 THEN day(t0) ELSE day(last_day(mk)) END AS dim FROM k1),
k3 AS (SELECT *, least(day(t0), min(dim) OVER (PARTITION BY symbol ORDER BY k {RUN})) AS dd FROM k2),
k4 AS (SELECT symbol, k, t0, t1, make_date(CAST(year(mk) AS INTEGER), CAST(month(mk) AS INTEGER), CAST(dd AS INTEGER)) AS cur FROM k3),
wins AS (SELECT symbol, k, t1, CAST(cur AS TIMESTAMP) + (t0 - date_trunc('day', t0)) AS cursor,
  CAST(cur + INTERVAL 24 MONTH AS TIMESTAMP) + (t0 - date_trunc('day', t0)) AS is_end,
  CAST((cur + INTERVAL 24 MONTH) + INTERVAL 6 MONTH AS TIMESTAMP) + (t0 - date_trunc('day', t0)) AS oos_end FROM k4),
wins2 AS (SELECT * FROM wins WHERE oos_end <= t1 + INTERVAL 1 DAY),
mem AS (SELECT b.*, w.k, CASE WHEN b.ts < w.is_end THEN 'is' ELSE 'oos' END AS segment
  FROM day_bars b JOIN wins2 w ON w.symbol = b.symbol AND b.ts >= w.cursor AND b.ts < w.oos_end),
kept0 AS (SELECT symbol, k, count_if(segment = 'is') AS n_is, count_if(segment = 'oos') AS n_oos,
    CAST(min(CASE WHEN segment = 'is' THEN ts END) AS DATE) AS is_start,
    CAST(max(CASE WHEN segment = 'is' THEN ts END) AS DATE) AS is_end,
    CAST(min(CASE WHEN segment = 'oos' THEN ts END) AS DATE) AS oos_start,
    CAST(max(CASE WHEN segment = 'oos' THEN ts END) AS DATE) AS oos_end
  FROM mem GROUP BY symbol, k HAVING count_if(segment = 'is') > 100 AND count_if(segment = 'oos') > 10),
kept AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY k) AS INTEGER) AS window_idx FROM kept0),
mem2 AS (SELECT m.* FROM mem m WHERE EXISTS (SELECT 1 FROM kept k WHERE k.symbol = m.symbol AND k.k = m.k)),
sm AS (SELECT *,
    {smas}
  FROM mem2),
grid AS (SELECT * FROM (VALUES {combos}) g(combo_idx, fast_period, slow_period)),
gx AS (SELECT sm.*, grid.combo_idx, grid.fast_period, grid.slow_period,
  coalesce(({fast}) > ({slow}), false) AS above FROM sm CROSS JOIN grid),
g2 AS (SELECT *, lag(above) OVER {w(K, 'ts')} AS prev_above FROM gx),
g3 AS (SELECT *, CASE WHEN above AND prev_above = false THEN 1
                      WHEN NOT above AND prev_above = true THEN -1 ELSE 0 END AS raw FROM g2),
sig AS (SELECT *, coalesce(lag(raw) OVER {w(K, 'ts')}, 0) AS signal FROM g3),
{ledger('sig', K, 'ts', pv, fee, cash)},
seg0 AS (SELECT {K}, count(*) AS n_bars, min(ts) AS t0, max(ts) AS t1, avg(ret) AS mr, stddev_samp(ret) AS sr
  FROM led GROUP BY {K}),
seg1 AS (SELECT *, CASE WHEN n_bars < 2 THEN 245.0 ELSE 31557600.0 / ({secs} / (n_bars - 1)) END AS freq FROM seg0),
segm AS (SELECT {K}, CASE WHEN sr IS NULL THEN NULL WHEN sr = 0 THEN 0.0
  ELSE (mr - 0.015 / freq) / sr * sqrt(freq) END AS sharpe FROM seg1),
best0 AS (SELECT *, row_number() OVER (PARTITION BY symbol, k ORDER BY sharpe DESC NULLS LAST, combo_idx) AS rk
  FROM segm WHERE segment = 'is'),
best AS (SELECT b.symbol, b.k, b.combo_idx, g.fast_period, g.slow_period,
    greatest(coalesce(b.sharpe, 0.0), 0.0) AS is_sharpe, o.sharpe AS oos_sharpe
  FROM best0 b JOIN grid g ON g.combo_idx = b.combo_idx
  LEFT JOIN segm o ON o.symbol = b.symbol AND o.k = b.k AND o.combo_idx = b.combo_idx AND o.segment = 'oos'
  WHERE b.rk = 1),
bw AS (SELECT *, CASE WHEN is_sharpe > 0 THEN oos_sharpe / is_sharpe ELSE 0.0 END AS ratio FROM best)"""


def wfa_windows_q() -> str:
    return f"""{_wfa_core()}
SELECT k.symbol, k.window_idx, k.n_is, k.n_oos, k.is_start, k.is_end, k.oos_start, k.oos_end,
  b.combo_idx, b.fast_period, b.slow_period, round(b.is_sharpe, 6) AS is_sharpe,
  round(b.oos_sharpe, 6) AS oos_sharpe, round(b.ratio, 6) AS ratio
FROM kept k JOIN bw b ON b.symbol = k.symbol AND b.k = k.k"""


def wfa_summary_q() -> str:
    def sa(c):
        return f"CASE WHEN count({c}) = count(*) THEN avg({c}) END"
    return f"""{_wfa_core()},
su AS (SELECT b.symbol, count(*) AS n_windows, {sa('is_sharpe')} AS avg_is_sharpe,
  {sa('oos_sharpe')} AS avg_oos_sharpe, {sa('ratio')} AS avg_ratio,
  count_if(ratio >= 0.6) AS windows_passed
  FROM kept k JOIN bw b ON b.symbol = k.symbol AND b.k = k.k GROUP BY b.symbol),
su2 AS (SELECT *, coalesce(avg_ratio < 0.6, false) AS overfitting,
  CASE WHEN avg_is_sharpe > 0 THEN avg_oos_sharpe / avg_is_sharpe ELSE 0.0 END AS ratio_of_means FROM su)
SELECT symbol, n_windows, round(avg_is_sharpe, 6) AS avg_is_sharpe, round(avg_oos_sharpe, 6) AS avg_oos_sharpe,
  round(avg_ratio, 6) AS avg_ratio, windows_passed, overfitting, round(ratio_of_means, 6) AS ratio_of_means,
  coalesce(ratio_of_means < 0.6, false) AS overfitting_rom FROM su2"""


# --------------------------------------------------------------------------
# retrieval (embeddings as the developed collection)
# --------------------------------------------------------------------------

DEV = """dev AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS sem,
  CAST(list_reverse(embedding) AS DOUBLE[]) AS meta, label AS logic_type,
  CAST(vec_id % 4 AS INTEGER) AS trading_session, (vec_id % 37) / 10.0 AS sharpe,
  (vec_id % 11) = 0 AS overfitting_flag FROM embeddings)"""


def _topk_sql(k: int, coll: str = "dev", extra: str = "") -> str:
    return f"""pairs AS (SELECT q.id AS qid, c.id AS id, list_cosine_similarity(q.sem, c.sem) AS similarity
  FROM dev q JOIN {coll} c ON q.id <> c.id {extra}),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS INTEGER) AS rank
  FROM pairs)"""


def vector_topk_q() -> str:
    return f"""WITH {DEV}, {_topk_sql(5)}
SELECT qid, rank, id, round(similarity, 6) AS similarity, round(1.0 - similarity, 6) AS distance
FROM ranked WHERE rank <= 5"""


def failed_topk_q() -> str:
    return f"""WITH {DEV}, fail AS (SELECT * FROM dev WHERE logic_type = 9), {_topk_sql(2, 'fail')}
SELECT qid, rank, id, round(similarity, 6) AS similarity, round(1.0 - similarity, 6) AS distance
FROM ranked WHERE rank <= 2"""


LAYERED = f"""{DEV},
meta AS (SELECT q.id AS qid, c.id AS id, list_cosine_similarity(q.meta, c.meta) AS ms
  FROM dev q JOIN dev c ON q.id <> c.id AND c.trading_session = q.trading_session
  AND c.logic_type = q.logic_type AND NOT c.overfitting_flag),
meta20 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ms DESC, id) AS r FROM meta) WHERE r <= 20),
sem AS (SELECT m.qid, m.id, list_cosine_similarity(q.sem, c.sem) AS similarity, c.sharpe, c.sem
  FROM meta20 m JOIN dev c ON c.id = m.id JOIN dev q ON q.id = m.qid),
lay AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS INTEGER) AS rank
  FROM sem) WHERE rank <= 5)"""


def layered_search_q() -> str:
    return f"WITH {LAYERED}\nSELECT qid, rank, id, round(similarity, 6) AS similarity FROM lay"


def diversity_filter_q(threshold: float = 0.3) -> str:
    return f"""WITH RECURSIVE {LAYERED},
c AS (SELECT qid, id, sharpe, sem, CAST(row_number() OVER (PARTITION BY qid ORDER BY sharpe DESC, id) AS INTEGER) AS o FROM lay),
g AS (
  SELECT qid, o, CASE WHEN true THEN [struct_pack(id := id, s := sharpe, v := sem)] END AS kept FROM c WHERE o = 1
  UNION ALL
  SELECT c.qid, c.o,
    CASE WHEN len(g.kept) < 3 AND NOT list_bool_or(list_transform(g.kept, lambda k: list_cosine_similarity(k.v, c.sem) > {threshold}))
         THEN list_append(g.kept, struct_pack(id := c.id, s := c.sharpe, v := c.sem)) ELSE g.kept END
  FROM g JOIN c ON c.qid = g.qid AND c.o = g.o + 1),
fin AS (SELECT qid, arg_max(kept, o) AS kept FROM g GROUP BY qid),
ex AS (SELECT qid, unnest(range(1, len(kept) + 1)) AS pick, unnest(kept) AS e FROM fin)
SELECT qid, CAST(pick AS INTEGER) AS pick, e.id AS id, round(e.s, 6) AS sharpe FROM ex"""


def batch_diversity_q() -> str:
    ns = ", ".join(f"count_if(trading_session = {s}) AS n_session_{s}" for s in range(4))
    return f"""WITH {DEV},
pr AS (SELECT a.logic_type, avg(list_cosine_similarity(a.sem, b.sem)) AS mean_similarity
  FROM dev a JOIN dev b ON a.logic_type = b.logic_type AND a.id < b.id GROUP BY a.logic_type),
ct AS (SELECT logic_type, count(*) AS n_items, {ns} FROM dev GROUP BY logic_type)
SELECT ct.logic_type, n_items, round(mean_similarity, 6) AS mean_similarity,
  n_session_0, n_session_1, n_session_2, n_session_3,
  round(1.0 - mean_similarity, 6) AS diversity_score, (1.0 - mean_similarity) < 0.3 AS low_diversity
FROM ct JOIN pr ON pr.logic_type = ct.logic_type"""


RANKED20 = f"""{DEV}, {_topk_sql(20)},
r20 AS (SELECT r.*, c.logic_type AS c_logic, q.logic_type AS q_logic FROM ranked r
  JOIN dev c ON c.id = r.id JOIN dev q ON q.id = r.qid WHERE r.rank <= 20),
per AS (SELECT qid, max(CASE WHEN c_logic = q_logic AND rank <= 5 THEN 1 ELSE 0 END) AS hit_at_k,
  coalesce(1.0 / min(CASE WHEN c_logic = q_logic AND rank <= 20 THEN rank END), 0.0) AS reciprocal_rank
  FROM r20 GROUP BY qid)"""


def retrieval_eval_q() -> str:
    return f"""WITH {RANKED20}
SELECT count(*) AS n_cases, round(avg(hit_at_k), 6) AS recall_at_5, round(avg(reciprocal_rank), 6) AS mrr,
  CAST(0.6 AS DOUBLE) AS recall_target, CAST(0.4 AS DOUBLE) AS mrr_target, avg(hit_at_k) >= 0.6 AND avg(reciprocal_rank) >= 0.4 AS passed
FROM per"""


def retrieval_cases_q() -> str:
    return f"WITH {RANKED20}\nSELECT qid, hit_at_k, round(reciprocal_rank, 6) AS reciprocal_rank FROM per"


def diversify_by_type_q() -> str:
    return f"""WITH {RANKED20}
SELECT qid, c_logic, id, round(similarity, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY qid, c_logic ORDER BY similarity DESC, id) AS rr FROM r20) WHERE rr = 1"""


def collection_search_q() -> str:
    return f"""WITH {DEV}, fail AS (SELECT * FROM dev WHERE logic_type = 9),
d AS (SELECT * FROM (SELECT q.id AS qid, c.id, list_cosine_similarity(q.sem, c.sem) AS similarity,
    row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.sem, c.sem) DESC, c.id) AS r
  FROM dev q JOIN dev c ON q.id <> c.id) WHERE r <= 5 AND similarity >= 0.0),
f AS (SELECT * FROM (SELECT q.id AS qid, c.id, list_cosine_similarity(q.sem, c.sem) AS similarity,
    row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.sem, c.sem) DESC, c.id) AS r
  FROM dev q JOIN fail c ON q.id <> c.id) WHERE r <= 2 AND similarity >= 0.1),
u AS (SELECT qid, 'developed' AS collection, id, similarity, 1.0 * similarity AS score FROM d
  UNION ALL SELECT qid, 'failed', id, similarity, 0.5 * similarity FROM f)
SELECT qid, collection, id, round(similarity, 6) AS similarity, round(score, 6) AS score,
  CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, collection, id) AS INTEGER) AS rank FROM u"""


def fill_short_results_q() -> str:
    return f"""WITH {LAYERED},
l2 AS (SELECT qid, id, similarity, 0 AS src FROM lay WHERE similarity > 0.2),
fb AS (SELECT * FROM (SELECT q.id AS qid, c.id, list_cosine_similarity(q.sem, c.sem) AS similarity,
    row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.sem, c.sem) DESC, c.id) AS r
  FROM dev q JOIN dev c ON q.id <> c.id) WHERE r <= 5),
fb2 AS (SELECT qid, id, similarity, 1 AS src FROM fb f WHERE NOT EXISTS (SELECT 1 FROM l2 WHERE l2.qid = f.qid AND l2.id = f.id)),
u AS (SELECT * FROM l2 UNION ALL SELECT * FROM fb2),
s AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY src, round(similarity, 12) DESC, id) AS INTEGER) AS slot FROM u)
SELECT qid, slot, id, round(similarity, 6) AS similarity FROM s WHERE slot <= 3"""


# --------------------------------------------------------------------------
# text jobs (entity decoding limited to the entities present in the data)
# --------------------------------------------------------------------------

def unescape_sql(x: str) -> str:
    return (f"replace(replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), "
            f"'&quot;', '\"'), '&amp;', '&'), '&amp', '&')")


def _title(h: str = "html") -> str:
    t = f"regexp_extract({h}, '(?is)<title[^>]*>(.*?)</title>', 1)"
    return f"substring(trim({unescape_sql(f'regexp_replace({t}, chr(92) || \'s+\', \' \', \'g\')')}), 1, 200)"


def _text(h: str = "html") -> str:
    t = f"regexp_replace({h}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g')"
    t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    t = f"trim(regexp_replace({unescape_sql(t)}, '\\s+', ' ', 'g'))"
    return t


PAGES = f"""pg AS (SELECT page_id, url, {_title()} AS title, {_text()} AS text FROM pages)"""


def page_title_text_q() -> str:
    return f"""WITH {PAGES}
SELECT page_id, title, CASE WHEN title = '' THEN url ELSE title END AS title_or_url, text,
  CAST(length(text) AS INTEGER) AS n_chars FROM pg"""


def page_dedup_q() -> str:
    return f"""WITH {PAGES},
h AS (SELECT page_id, sha256(regexp_replace(lower(regexp_replace(url, '#.*$', '')), '/+$', '')) AS url_hash,
  sha256(text) AS content_hash FROM pg)
SELECT page_id, url_hash, content_hash,
  row_number() OVER (PARTITION BY url_hash ORDER BY page_id) = 1
  AND row_number() OVER (PARTITION BY content_hash ORDER BY page_id) = 1 AS keep FROM h"""


def page_list_filter_q() -> str:
    host = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1))"
    return f"""WITH h AS (SELECT page_id, {host} AS host FROM pages),
d AS (SELECT *, regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS domain FROM h)
SELECT page_id, host, domain FROM d
WHERE domain IN ('example.com', 'example.org') AND NOT starts_with(host, 'm.')"""


def knowledge_context_q() -> str:
    return f"""WITH {PAGES},
t AS (SELECT *, regexp_extract(url, '://[^/]+/([a-z]{{2}})/', 1) AS tag FROM pg WHERE length(text) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY page_id) AS rr FROM t)
SELECT tag, count(*) AS n_pages,
  string_agg('### [' || title || '](' || url || ')' || chr(10) || substring(text, 1, 3000) || chr(10), chr(10)
             ORDER BY page_id) AS context
FROM r WHERE rr <= 8 GROUP BY tag"""


def document_dedup_q() -> str:
    return """WITH d AS (SELECT doc_id, sha256(text) AS content_hash FROM documents)
SELECT doc_id, content_hash, min(doc_id) OVER (PARTITION BY content_hash) AS first_doc_id,
  doc_id <> min(doc_id) OVER (PARTITION BY content_hash) AS is_duplicate FROM d"""


def script_lint_q() -> str:
    B0, B1 = "(^|[^a-z0-9_])", "([^a-z0-9_]|$)"
    nb = f"{B0}next bar{B1}"

    def has(p):
        return f"regexp_matches(t, '{p}')"

    def cnt(wd):
        return f"len(list_filter(regexp_split_to_array(t, '[^a-z0-9_]+'), lambda x: x = '{wd}'))"

    rules = [
        ("R01", "fatal", f"NOT {has(B0 + 'inputs?' + chr(92) + 's*:')}"),
        ("R02", "fatal", f"NOT {has(B0 + '(vars?|variables?)' + chr(92) + 's*:')}"),
        ("R03", "fatal", f"NOT {has(B0 + 'buy' + B1 + '.*' + nb)}"),
        ("R04", "high", f"NOT {has(B0 + 'sell' + chr(92) + 's+short' + B1 + '.*' + nb)}"),
        ("R05", "fatal", f"NOT {has(B0 + '(setstoploss|setpercenttrailing|setdollartrailing)' + B1)}"),
        ("R06", "medium", f"NOT {has(B0 + 'entriestoday' + chr(92) + 's*' + chr(92) + '(.*' + chr(92) + ')' + chr(92) + 's*=' + chr(92) + 's*0')}"),
        ("R07", "fatal", f"{cnt('begin')} <> {cnt('end')}"),
        ("R08", "fatal", f"{cnt('if')} > {cnt('then')}"),
    ]
    for kw in ["volume", "ticks", "openint", "timetominutes", "intrabarordergeneration"]:
        rules.append(("R09", "fatal", has(B0 + kw + B1)))
    s = chr(92) + "s*"
    rules.append(("R10", "fatal", f"NOT {has(B0 + 'time' + s + '=' + s + '1339' + B1)}"))
    rules.append(("R11", "high", f"NOT {has(B0 + 'time' + s + '>=' + s + '0?845' + B1)}"))
    bare = f"regexp_extract_all(t, '{B0}(buy{chr(92)}s+{chr(92)}d*{chr(92)}s*shares?{chr(92)}s+at{chr(92)}s+market){B1}', 2)"
    rules.append(("R12", "high", f"len({bare}) > 0 AND NOT list_bool_and(list_transform({bare}, lambda b: contains(b, 'next bar')))"))
    arr = ", ".join(f"CASE WHEN {cond} THEN '{r}|{sev}' END" for r, sev, cond in rules)
    return f"""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents),
i AS (SELECT doc_id, list_filter([{arr}], lambda x: x IS NOT NULL) AS iss FROM d)
SELECT doc_id, array_to_string(list_transform(iss, lambda x: split_part(x, '|', 1)), ',') AS rules,
  CAST(len(list_filter(iss, lambda x: split_part(x, '|', 2) = 'fatal')) AS INTEGER) AS n_fatal,
  len(list_filter(iss, lambda x: split_part(x, '|', 2) = 'fatal')) = 0 AS passed FROM i"""


def _dedent_strip_sql(x: str) -> str:
    lines = f"string_split({x}, chr(10))"
    ind = (f"list_transform(list_filter({lines}, lambda l: length(trim(l)) > 0), "
           f"lambda l: length(regexp_extract(l, '^[ \\t]*', 0)))")
    m = f"coalesce(list_min({ind}), 0)"
    body = (f"array_to_string(list_transform({lines}, lambda l: CASE WHEN length(trim(l)) = 0 THEN '' "
            f"ELSE substring(l, {m} + 1) END), chr(10))")
    return f"regexp_replace({body}, '^\\s+|\\s+$', '', 'g')"


# Required interface tokens and the messages of the check (K6)
_REQUIRED = [
    ("BaseStrategy", "missing BaseStrategy base class"), ("NAME", "missing NAME class attribute"),
    ("PARAMS", "missing PARAMS class attribute"), ("CATEGORY", "missing CATEGORY class attribute"),
    ("HOLDING_TYPE", "missing HOLDING_TYPE class attribute (daytrade / swing)"),
    ("TIMEFRAME", 'missing TIMEFRAME class attribute (e.g. TIMEFRAME = "15min")'),
    ("generate_signals", "missing generate_signals() method"), ("metadata", "missing metadata() method"),
    ("validate_params", "missing validate_params() method"),
    ("shift(1)", "generate_signals() must call shift(1) to avoid look-ahead")]

# documents as scripts: comments of every kind, and for even ids the method that is summarised
SCRIPTS = """sc AS (SELECT doc_id, source, text || chr(10) || '// note é' || chr(10) || 'x = 1 // tail ü' || chr(13) || chr(10)
  || 'buy {' || lang || ' ñ} now // ok ö' || chr(10) || 'sell {ß} next' || chr(10) || 'keep {this} // ascii' || chr(10) || '{open é'
  || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'class A:' || chr(10) || '    NAME = "' || source || '"' || chr(10)
     || '    def generate_signals(self):' || chr(10) || '        ' || text || '  ' || chr(10) || chr(10) || '        return 1' || chr(10)
     || '    def other(self):' || chr(10) || '        pass' ELSE '' END AS code FROM documents)"""


def script_checks_q() -> str:
    def attr(key, default):
        v = f"regexp_extract(code, '{key}\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1)"
        return f"CASE WHEN {v} = '' THEN '{default}' ELSE {v} END"
    msgs = ", ".join(f"CASE WHEN NOT contains(code, '{t}') THEN '{m.replace(chr(39), chr(39) * 2)}' END"
                     for t, m in _REQUIRED)
    eff = ("len(list_filter(list_transform(string_split(code, chr(10)), lambda l: trim(l)), "
           "lambda l: l <> '' AND NOT starts_with(l, '//')))")
    foreign = "regexp_matches(l, '[^\\x00-\\x7F]')"
    lines = "string_split_regex(regexp_replace(code, '(\\r\\n|\\n|\\r)$', ''), '\\r\\n|\\n|\\r')"
    kept = f"list_filter({lines}, lambda l: NOT (regexp_matches(l, '^\\s*//') AND {foreign}))"
    cut = (f"lambda l: CASE WHEN contains(l, '//') AND {foreign} "
           "THEN regexp_replace(substring(l, 1, instr(l, '//') - 1), '\\s+$', '') ELSE l END")
    bare = (f"lambda l: CASE WHEN contains(l, '{{') AND contains(l, '}}') AND {foreign} "
            "THEN regexp_replace(regexp_replace(l, '\\{[^}]*\\}', '', 'g'), '\\s+$', '') ELSE l END")
    stripped = f"array_to_string(list_transform(list_transform({kept}, {cut}), {bare}), chr(13) || chr(10))"
    body = "regexp_extract(code, '(?s)(def generate_signals.*?)(\\n    def |\\nclass |\\z)', 1)"
    full = (f"array_to_string(list_slice(list_filter(list_transform(string_split_regex({body}, '\\r\\n|\\n|\\r'), "
            f"lambda l: regexp_replace(l, '\\s+$', '')), lambda l: l <> ''), 1, 8), ' | ')")
    summ = (f"CASE WHEN {body} = '' THEN '(無法擷取摘要)' ELSE substring({full}, 1, 300) || "
            f"CASE WHEN length({full}) > 300 THEN '...' ELSE '' END END")
    return f"""WITH {SCRIPTS}
SELECT doc_id, {attr('NAME', 'Unknown')} AS name, {attr('CATEGORY', 'unknown')} AS category,
  {attr('TIMEFRAME', '1min')} AS timeframe, {attr('HOLDING_TYPE', 'daytrade')} AS holding_type,
  array_to_string(list_filter([{msgs}], lambda x: x IS NOT NULL), '; ') AS missing,
  CAST({eff} AS INTEGER) AS effective_lines,
  regexp_replace(source, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g') AS safe_source,
  sha256({stripped}) AS stripped_hash, {summ} AS summary
FROM sc"""


OUTPUTS = """o0 AS (SELECT conv_id, turn, text AS source_text,
  CAST(json_object('analysis', text, 'suggestions', json_array(json_object('title', 's' || CAST(turn AS VARCHAR),
    'new_params', json_object('k', turn)))) AS VARCHAR) AS obj FROM conversations WHERE role = 'assistant'),
o1 AS (SELECT conv_id, turn, source_text,
  CASE conv_id % 4 WHEN 0 THEN 'Here is the plan:' || chr(10) || '```json' || chr(10) || obj || chr(10) || '```' || chr(10)
       WHEN 1 THEN obj WHEN 2 THEN 'Result follows ' || obj || ' end.'
       ELSE '```json' || chr(10) || substring(obj, 2) || chr(10) || '```' END AS output FROM o0)"""


def json_payloads_q() -> str:
    def ok(s):
        return f"CASE WHEN json_valid({s}) AND starts_with(ltrim({s}), '{{') THEN {s} END"
    fence = "regexp_extract(output, '(?s)```json\\s*\\n(.*?)```', 1)"
    first = "instr(output, '{')"
    rpos = "instr(reverse(output), '}')"
    last = f"(length(output) - {rpos} + 1)"
    span = f"CASE WHEN {first} > 0 AND {rpos} > 0 AND {last} > {first} THEN substring(output, {first}, {last} - {first} + 1) END"
    bare = "regexp_extract(output, '(?s)```\\s*\\n(.*?)```', 1)"
    fj = _dedent_strip_sql("regexp_extract(output, '(?is)```json\\s*\\n(.*?)```', 1)")
    fb = _dedent_strip_sql(bare)
    return f"""WITH {OUTPUTS},
o2 AS (SELECT *, {ok('output')} AS w, {ok(fence)} AS f, {ok(span)} AS b FROM o1),
o3 AS (SELECT *, coalesce(w, f, b) AS js,
  CASE WHEN w IS NOT NULL THEN 'whole' WHEN f IS NOT NULL THEN 'fence' WHEN b IS NOT NULL THEN 'braces'
       ELSE 'failed' END AS method,
  coalesce(nullif({fj}, ''), nullif({fb}, ''), '') AS fenced FROM o2)
SELECT conv_id, turn, method, js IS NOT NULL AS parsed, json_extract_string(js, '$.analysis') = source_text AS analysis_ok,
  CAST(json_array_length(js, '$.suggestions') AS INTEGER) AS n_suggestions, CAST(length(fenced) AS INTEGER) AS fence_chars
FROM o3"""


VLOG = """vl AS (SELECT event_id AS log_id, user_id AS strategy_id, CAST(event_id % 3 + 1 AS INTEGER) AS layer,
  NOT (event_type IN ('error', 'click', 'view')) AS passed,
  CASE event_type
    WHEN 'error' THEN printf('Unknown identifier ''V%d'' at line %d', CAST(json_extract_string(props, '$.k') AS BIGINT) % 7, event_id % 50)
    WHEN 'click' THEN printf('Mismatched ''Begin'' at line %d', event_id % 50)
    WHEN 'view' THEN printf('Expected '';'' at line %d', event_id % 50)
    ELSE 'Compiler warning' END AS message, ts AS created_at FROM events),
vp AS (SELECT *, CASE WHEN contains(message, 'Unknown identifier') AND regexp_extract(message, '''([A-Za-z0-9_]+)''', 1) <> ''
    THEN 'UNKNOWN_IDENTIFIER:' || regexp_extract(message, '''([A-Za-z0-9_]+)''', 1)
  WHEN contains(message, 'Mismatched') THEN 'MISMATCHED_BEGIN_END'
  WHEN contains(message, 'Expected') THEN 'SYNTAX_EXPECTED' ELSE 'OTHER' END AS error_pattern FROM vl)"""


def error_patterns_q() -> str:
    return f"WITH {VLOG}\nSELECT log_id, layer, passed, error_pattern FROM vp"


def top_failure_patterns_q() -> str:
    return f"""WITH {VLOG}, g AS (SELECT error_pattern, count(*) AS cnt FROM vp WHERE NOT passed AND layer = 3 GROUP BY 1)
SELECT error_pattern, cnt, CAST(row_number() OVER (ORDER BY cnt DESC, error_pattern) AS INTEGER) AS rank
FROM g QUALIFY rank <= 5"""


def frequent_patterns_q() -> str:
    return f"""WITH {VLOG}
SELECT error_pattern, count(*) AS cnt FROM vp WHERE NOT passed GROUP BY 1 HAVING count(*) >= 50"""


# --------------------------------------------------------------------------
# operational analytics on the call log
# --------------------------------------------------------------------------

CALLS = CALLS_FX + """,
calls AS (SELECT *, (['step1_intent', 'step2_retrieve', 'step3_skeleton', 'step4_el', 'step5_critique'])[call_id % 5 + 1]
  AS prompt_step, CAST(tokens / 10 AS BIGINT) AS latency_ms FROM calls_fx)"""


def _mode(x: str) -> str:
    return (f"CASE WHEN {x} < 7.0 THEN 'normal' WHEN {x} < 9.5 THEN 'throttle' WHEN {x} < 10.0 THEN 'survival' "
            f"ELSE 'hard_stop' END")


def budget_status_q() -> str:
    return f"""WITH {CALLS},
d AS (SELECT CAST(created_at AS DATE) AS day, sum(cost_usd) AS today_used_usd, count(*) AS n_calls FROM calls GROUP BY 1),
wk AS (SELECT CAST(date_trunc('week', day) AS DATE) AS week, sum(today_used_usd) AS tw FROM d GROUP BY 1)
SELECT day, round(today_used_usd, 6) AS today_used_usd, n_calls, round(tw, 6) AS this_week_total_usd,
  10.0::DOUBLE AS today_limit_usd, round(today_used_usd / 10.0, 6) AS today_used_percent, {_mode('today_used_usd')} AS current_mode
FROM d JOIN wk ON wk.week = CAST(date_trunc('week', d.day) AS DATE)"""


def budget_breakdown_q() -> str:
    return f"""WITH {CALLS}, x AS (SELECT *, CAST(created_at AS DATE) AS day FROM calls)
SELECT day, 'provider' AS dimension, provider AS key, round(sum(cost_usd), 6) AS cost_usd, count(*) AS n_calls FROM x GROUP BY 1, 3
UNION ALL SELECT day, 'step', prompt_step, round(sum(cost_usd), 6), count(*) FROM x GROUP BY 1, 3
UNION ALL SELECT day, 'total', 'all', round(sum(cost_usd), 6), count(*) FROM x GROUP BY 1"""


def daily_rollup_q() -> str:
    return f"""WITH {CALLS}
SELECT CAST(created_at AS DATE) AS day, count(*) AS attempts, count_if(success) AS successes, sum(tokens) AS tokens_used,
  (count(*) - count_if(success)) >= 10 OR sum(tokens) >= 1000000 AS stop FROM calls GROUP BY 1"""


def running_spend_q() -> str:
    before = "coalesce(sum(cost_usd) OVER (PARTITION BY day ORDER BY created_at, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)"
    return f"""WITH {CALLS}, x AS (SELECT *, CAST(created_at AS DATE) AS day FROM calls),
y AS (SELECT *, sum(cost_usd) OVER (PARTITION BY day ORDER BY created_at, call_id {RUN}) AS spent, {before} AS spent_before FROM x),
z AS (SELECT *, {_mode('spent_before')} AS mode FROM y)
SELECT call_id, day, provider, round(spent, 6) AS spent, round(spent_before, 6) AS spent_before, mode,
  CASE mode WHEN 'normal' THEN true WHEN 'throttle' THEN provider NOT IN ('purchase')
            WHEN 'survival' THEN provider IN ('view') ELSE false END AS allowed FROM z"""


def fail_streaks_q() -> str:
    w_ = f"(PARTITION BY request ORDER BY created_at, call_id {RUN})"
    return f"""WITH {CALLS},
x AS (SELECT *, sum(CASE WHEN success THEN 0 ELSE 1 END) OVER {w_} AS cf FROM calls),
y AS (SELECT *, cf - coalesce(last_value(CASE WHEN success THEN cf END IGNORE NULLS) OVER {w_}, 0) AS fail_streak FROM x)
SELECT call_id, request, fail_streak, fail_streak >= 3 AS alert FROM y"""


def provider_rates_q() -> str:
    return f"""WITH {CALLS}
SELECT provider, count(*) AS n_calls, round(avg(CAST(success AS DOUBLE)), 6) AS success_rate,
  round(avg(cost_usd), 6) AS avg_cost_usd, round(avg(latency_ms), 6) AS avg_latency_ms,
  avg(CAST(success AS DOUBLE)) < 0.3 AS low_success FROM calls GROUP BY provider"""


def layer_pass_rates_q() -> str:
    return f"WITH {VLOG}\nSELECT layer, count(*) AS n, round(avg(CAST(passed AS DOUBLE)), 6) AS pass_rate FROM vl GROUP BY layer"


def cost_quality_q() -> str:
    return f"""WITH {CALLS},
oc AS (SELECT user_id AS request, CAST(max(CAST(event_type = 'purchase' AS INTEGER)) AS BOOLEAN) AS p FROM events GROUP BY 1),
j AS (SELECT c.*, coalesce(oc.p, false) AS ok FROM calls c LEFT JOIN oc ON oc.request = c.request),
g AS (SELECT provider, sum(cost_usd) AS cost_usd, count(DISTINCT CASE WHEN ok THEN request END) AS passed_requests,
  avg(CAST(NOT success AS DOUBLE)) AS failure_rate FROM j GROUP BY provider)
SELECT provider, round(cost_usd, 6) AS cost_usd, passed_requests, round(failure_rate, 6) AS failure_rate,
  round(passed_requests / nullif(cost_usd, 0), 6) AS passed_per_usd,
  round(cost_usd / nullif(passed_requests, 0), 6) AS cost_per_pass FROM g"""


def step_failure_rates_q() -> str:
    return f"""WITH {CALLS}
SELECT prompt_step, count(*) AS n_calls, round(avg(CAST(NOT success AS DOUBLE)), 6) AS failure_rate FROM calls GROUP BY 1"""


def first_success_q() -> str:
    return f"""WITH {CALLS},
g AS (SELECT request, count(*) AS n_calls,
  arg_min(CASE WHEN success THEN {{'at': created_at, 'call_id': call_id, 'provider': provider}} END,
          CASE WHEN success THEN {{'a': created_at, 'b': call_id}} END) AS ok,
  arg_max(CASE WHEN NOT success THEN {{'at': created_at, 'call_id': call_id, 'provider': provider}} END,
          CASE WHEN NOT success THEN {{'a': created_at, 'b': call_id}} END) AS ko
  FROM calls GROUP BY request)
SELECT request, n_calls, ok IS NOT NULL AS succeeded, coalesce(ok, ko).provider AS provider,
  coalesce(ok, ko).call_id AS call_id, coalesce(ok, ko).at AS at FROM g"""


def weekly_quality_q() -> str:
    return f"""WITH {CALLS},
g AS (SELECT CAST(date_trunc('week', created_at) AS DATE) AS week, count(*) AS n_calls, sum(cost_usd) AS cost_usd,
  avg(CAST(success AS DOUBLE)) * 100 AS success_pct FROM calls GROUP BY 1),
h AS (SELECT *, success_pct - lag(success_pct) OVER (ORDER BY week) AS chg FROM g)
SELECT week, n_calls, round(cost_usd, 6) AS cost_usd, round(success_pct, 6) AS success_pct,
  round(chg, 6) AS success_pct_change, coalesce(chg < -5.0, false) AS alert FROM h"""


def metric_regression_q() -> str:
    return f"""WITH {CALLS},
m AS (SELECT provider, CAST(created_at AS DATE) AS day, avg(CAST(success AS DOUBLE)) AS value FROM calls GROUP BY 1, 2),
r AS (SELECT *, lag(value) OVER (PARTITION BY provider ORDER BY day) AS previous FROM m)
SELECT provider, day, round(value, 6) AS value, round(previous, 6) AS previous, round(value - previous, 6) AS change,
  coalesce(previous - value > 0.05, false) AS regressed FROM r"""


def kpi_dashboard_q() -> str:
    ss = ", ".join(f"count_if(trading_session = {s}) AS session_{s}" for s in range(4))
    return f"""WITH {DEV}
SELECT count(*) AS strategy_count, round(avg(sharpe), 6) AS avg_sharpe, count_if(overfitting_flag) AS overfitting_count,
  count_if(overfitting_flag AND sharpe >= 1.2) AS pending_review_count, {ss},
  count(DISTINCT logic_type) AS logic_types FROM dev"""


def latest_trade_per_strategy_q() -> str:
    return f"""WITH {TRADES_FX},
n AS (SELECT strategy, count(*) AS n_children,
  arg_max({{'exit_ts': exit_ts, 'orderkey': orderkey, 'pnl': pnl}}, {{'a': exit_ts, 'b': orderkey, 'c': linenumber}}) AS l
  FROM trades_fx GROUP BY strategy)
SELECT s.s_suppkey AS strategy, s.s_name, n.n_children, n.l.exit_ts AS latest_exit_ts, n.l.orderkey AS latest_orderkey,
  round(n.l.pnl, 6) AS latest_pnl FROM supplier s LEFT JOIN n ON n.strategy = s.s_suppkey"""


def list_strategies_page_q() -> str:
    return f"""WITH {DEV}
SELECT id, logic_type, trading_session, sharpe FROM dev WHERE logic_type = 3 AND sharpe >= 1.0
ORDER BY sharpe DESC, id LIMIT 20 OFFSET 20"""


# --------------------------------------------------------------------------
# table maintenance, constraints, admission
# --------------------------------------------------------------------------

def _chk(table: str, pk=(), not_null=(), fks=()) -> list[str]:
    out = []
    if pk:
        cols = ", ".join(pk)
        key = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in pk)
        out.append(f"SELECT '{table}' AS \"table\", '{','.join(pk)}' AS \"constraint\", 'primary_key' AS kind, "
                   f"{key} AS key, count(*) AS n_rows FROM {table} GROUP BY {cols} HAVING count(*) > 1")
    for c in list(not_null) + list(pk):
        out.append(f"SELECT '{table}', '{c}', 'not_null', CAST(NULL AS VARCHAR), count(*) FROM {table} "
                   f"WHERE {c} IS NULL HAVING count(*) > 0")
    for col, parent, pcol in fks:
        out.append(f"SELECT '{table}', '{col}', 'foreign_key', CAST({col} AS VARCHAR), count(*) FROM {table} t "
                   f"WHERE {col} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pcol} = t.{col}) "
                   f"GROUP BY {col}")
    return out


def constraint_check_q() -> str:
    parts = (_chk("region", ["r_regionkey"]) + _chk("nation", ["n_nationkey"], fks=[("n_regionkey", "region", "r_regionkey")])
             + _chk("customer", ["c_custkey"], ["c_name"], [("c_nationkey", "nation", "n_nationkey")])
             + _chk("supplier", ["s_suppkey"], fks=[("s_nationkey", "nation", "n_nationkey")])
             + _chk("orders", ["o_orderkey"], ["o_orderdate"], [("o_custkey", "customer", "c_custkey")])
             + _chk("lineitem", ["l_orderkey", "l_linenumber"],
                    fks=[("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey"),
                         ("l_suppkey", "supplier", "s_suppkey")])
             + _chk("labels", ["doc_id"], fks=[("doc_id", "documents", "doc_id")]))
    return "\nUNION ALL\n".join(parts)


BARS_V2 = """v2 AS (SELECT o_orderpriority AS symbol, o_orderdate AS ts,
  arg_min(o_totalprice, {'a': o_custkey, 'b': o_orderkey}) AS open, max(o_totalprice) AS high,
  min(o_totalprice) AS low, arg_max(o_totalprice, {'a': o_custkey, 'b': o_orderkey}) AS close
  FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' GROUP BY 1, 2)"""


def upsert_merge_q() -> str:
    return rounded(f"""WITH {DAY_BARS}, {BARS_V2}
SELECT * FROM v2 UNION ALL
SELECT d.* FROM day_bars d WHERE NOT EXISTS (SELECT 1 FROM v2 WHERE v2.symbol = d.symbol AND v2.ts = d.ts)""", RES_COLS)


def merge_bars_q() -> str:
    return upsert_merge_q()


def clean_minute_bars_q() -> str:
    return rounded(f"""WITH {MINUTE_BARS}
SELECT symbol, ts, open, high, low, close FROM minute_bars
WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL
  AND high >= low AND open > 0 AND n_ticks <> 0""", RES_COLS)


def collection_listing_q() -> str:
    return f"""WITH {DEV}
SELECT trading_session, logic_type, id, round(sharpe, 6) AS sharpe, '' AS notes FROM dev WHERE NOT overfitting_flag"""


def knowledge_upsert_q() -> str:
    lang = "regexp_extract(url, '://[^/]+/([a-z]{2})/', 1)"
    return f"""WITH p AS (SELECT page_id AS id, url, html AS content FROM pages),
o AS (SELECT * FROM p WHERE {lang} IN ('en', 'fr'))
SELECT coalesce(o.id, p.id) AS id, coalesce(o.url, p.url) AS url,
  CASE WHEN o.url IS NOT NULL THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '2024-02-01 00:00:00' END AS added_at,
  CASE WHEN o.url IS NOT NULL THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '2024-02-01 00:00:00' END AS last_fetched,
  CASE WHEN p.url IS NOT NULL AND o.url IS NULL THEN 'added' WHEN p.url IS NOT NULL THEN 'already_exists' ELSE 'kept' END AS status,
  CAST(length(coalesce(o.content, p.content)) AS INTEGER) AS content_length
FROM o FULL OUTER JOIN p ON o.url = p.url"""


def admission_q() -> str:
    K = "symbol, k, segment, combo_idx"
    return f"""{_wfa_core(1.0, 1.0, 5000000.0)},
im AS (SELECT {K}, min(drawdown) AS mdd, count(trade_pnl) AS total_trades,
  sum(CASE WHEN trade_pnl > 0 THEN trade_pnl END) AS gp, sum(CASE WHEN trade_pnl < 0 THEN trade_pnl END) AS gl
  FROM led WHERE segment = 'is' GROUP BY {K}),
x AS (SELECT b.symbol, kp.window_idx, b.combo_idx, b.is_sharpe, b.oos_sharpe, b.ratio, s.sharpe, i.total_trades,
  abs(coalesce(i.mdd, 0.0)) AS dd,
  CASE WHEN coalesce(gl, 0) = 0 THEN (CASE WHEN coalesce(gp, 0) > 0 THEN 'inf'::DOUBLE ELSE 0.0 END) ELSE coalesce(gp, 0) / abs(gl) END AS pf
  FROM bw b JOIN kept kp ON kp.symbol = b.symbol AND kp.k = b.k
  JOIN segm s ON s.symbol = b.symbol AND s.k = b.k AND s.combo_idx = b.combo_idx AND s.segment = 'is'
  JOIN im i ON i.symbol = b.symbol AND i.k = b.k AND i.combo_idx = b.combo_idx),
y AS (SELECT *, NOT (coalesce(sharpe < 0.6, false) OR dd > 0.35 OR pf < 1.3 OR total_trades < 40) AS screen,
  NOT (coalesce(sharpe < 0.7, false) OR dd > 0.20 OR pf < 2.0 OR total_trades < 50) AND coalesce(ratio >= 0.6, false) AS strict,
  CASE WHEN is_sharpe <= 0 THEN true ELSE coalesce(oos_sharpe / is_sharpe < 0.6, true) END AS over FROM x)
SELECT symbol, window_idx, combo_idx, screen AS screen_passed, screen AND strict AS strict_passed, over AS overfit,
  screen AND oos_sharpe IS NOT NULL AS admitted, screen AND oos_sharpe IS NOT NULL AND over AS review_queue,
  CASE WHEN total_trades < 40 THEN 'insufficient_trades' WHEN coalesce(sharpe < 0.6, false) THEN 'low_sharpe'
       WHEN dd > 0.35 THEN 'high_drawdown' WHEN pf < 1.3 THEN 'low_profit_factor' ELSE 'passed' END AS failure_reason FROM y"""


# --------------------------------------------------------------------------
# streaming (batch equivalents)
# --------------------------------------------------------------------------

def stream_resample_5m_q() -> str:
    b = bin_expr("5min")
    return rounded(f"""WITH {TICKS}
SELECT symbol, {b} AS ts, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, ts) AS close FROM ticks GROUP BY symbol, {b}""", RES_COLS)


def stream_bars_5m_q() -> str:
    b = bin_expr("5min")
    return rounded(f"""WITH {TICKS}
SELECT symbol, {b} AS ts, arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, (ts, event_id)) AS close, count(*) AS n_ticks FROM ticks GROUP BY symbol, {b}""", RES_COLS)


def stream_alerts_q() -> str:
    lvl = ("CASE WHEN loss_streak >= 10 OR dd_ratio >= 0.8 THEN 'red' WHEN loss_streak >= 8 OR dd_ratio >= 0.7 "
           "THEN 'orange' WHEN loss_streak >= 5 OR dd_ratio >= 0.5 THEN 'yellow' ELSE 'green' END")
    return f"""WITH {TRADE_STREAKS},
h1 AS (SELECT *, 500000.0 + sum(pnl) OVER (PARTITION BY strategy ORDER BY rn {RUN}) AS equity FROM t3),
h2 AS (SELECT *, greatest(500000.0, max(equity) OVER (PARTITION BY strategy ORDER BY rn {RUN})) AS peak FROM h1),
h3 AS (SELECT *, (peak - equity) / peak / 0.2 AS dd_ratio FROM h2)
SELECT strategy, exit_ts, orderkey, linenumber, round(pnl, 6) AS pnl, loss_streak, round(dd_ratio, 6) AS dd_ratio,
  {lvl} AS level FROM h3"""


def stream_dedup_documents_q() -> str:
    return "SELECT DISTINCT sha256(text) AS content_hash FROM documents"


# --------------------------------------------------------------------------
# diagnostics, labels, reports, intents, prompt blocks, texts
# --------------------------------------------------------------------------

def rolling_sharpe_q() -> str:
    fr = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
    return f"""{_ma_ledger()}
SELECT symbol, ts, round(CASE WHEN count(ret) OVER {fr} = 60 AND stddev_samp(ret) OVER {fr} > 0
  THEN avg(ret) OVER {fr} / stddev_samp(ret) OVER {fr} * sqrt(245.0) END, 6)
  AS rolling_sharpe FROM led"""


def pnl_histogram_q() -> str:
    return f"""{_ma_ledger()},
t AS (SELECT symbol, trade_pnl AS pnl FROM led WHERE trade_pnl IS NOT NULL),
r AS (SELECT symbol, min(pnl) AS lo, max(pnl) AS hi FROM t GROUP BY symbol)
SELECT t.symbol, CAST(CASE WHEN hi = lo THEN 1 ELSE floor((pnl - lo) / (hi - lo) * 10) + 1 END AS INTEGER) AS bucket,
  count(*) AS n_trades FROM t JOIN r ON r.symbol = t.symbol GROUP BY 1, 2"""


def drawdown_episodes_q() -> str:
    return f"""{_ma_ledger()},
x AS (SELECT *, equity < peak AS uw FROM led),
y AS (SELECT *, sum(CASE WHEN uw THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY ts {RUN}) AS isl FROM x)
SELECT symbol, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_bars, round(min(drawdown), 6) AS depth
FROM y WHERE uw GROUP BY symbol, isl"""


def split_segments_q() -> str:
    return f"""WITH {DAY_BARS}
SELECT symbol, CASE WHEN ts >= TIMESTAMP '1995-01-01' AND ts <= TIMESTAMP '1999-12-31 23:59:59' THEN 'train'
  WHEN ts >= TIMESTAMP '2000-01-01' AND ts <= TIMESTAMP '2001-12-31 23:59:59' THEN 'test' ELSE 'outside' END AS segment,
  count(*) AS n_bars, min(ts) AS first_ts, max(ts) AS last_ts FROM day_bars GROUP BY 1, 2"""


def unpaired_labels_q() -> str:
    return """SELECT doc_id, 'label_without_document' AS side FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)
UNION ALL SELECT doc_id, 'document_without_label' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"""


def report_table_q() -> str:
    return f"""WITH m AS ({ma_cross_backtest_metrics()}),
u AS (SELECT symbol, 'sharpe' AS metric, sharpe AS value FROM m
  UNION ALL SELECT symbol, 'max_drawdown', max_drawdown FROM m
  UNION ALL SELECT symbol, 'profit_factor', profit_factor FROM m
  UNION ALL SELECT symbol, 'total_trades', CAST(total_trades AS DOUBLE) FROM m),
t AS (SELECT * FROM (VALUES ('sharpe', 1.2, '>='), ('max_drawdown', 0.35, '<='), ('profit_factor', 1.0, '>='),
  ('total_trades', 80.0, '>=')) v(metric, threshold, rule))
SELECT u.metric, u.symbol, u.value, CAST(t.threshold AS DOUBLE) AS threshold, t.rule,
  coalesce(CASE WHEN t.rule = '>=' THEN u.value >= t.threshold ELSE u.value <= t.threshold END, false) AS passed
FROM u JOIN t ON t.metric = u.metric"""


def strategy_report_q() -> str:
    return f"""WITH m AS ({ma_cross_backtest_metrics()}), w AS ({wfa_windows_q()}),
t AS (SELECT symbol, string_agg(printf('[%02d] IS %s..%s OOS %s..%s IS=%.2f OOS=%.2f', window_idx, CAST(is_start AS VARCHAR),
  CAST(is_end AS VARCHAR), CAST(oos_start AS VARCHAR), CAST(oos_end AS VARCHAR), is_sharpe, oos_sharpe), chr(10) ORDER BY window_idx) AS windows
  FROM w GROUP BY symbol)
SELECT m.symbol, m.sharpe, m.max_drawdown, m.profit_factor, m.total_trades, m.passed, t.windows
FROM m LEFT JOIN t ON t.symbol = m.symbol"""


def validate_intents_q() -> str:
    k = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
    sess = f"(['daytrade_day', 'daytrade_night', 'swing_day', 'swing_full', 'allday'])[{k} % 5 + 1]"
    logic = "(['trend', 'mean_reversion', 'tunnel', 'pattern'])[user_id % 4 + 1]"
    tf = "(['1min', '5min', '15min', '30min', '60min', '1d', '2min'])[event_id % 7 + 1]"
    return f"""WITH i AS (SELECT event_id, {sess} AS s, {logic} AS lg, {tf} AS tf, round(value / 500.0, 4) AS conf FROM events),
r AS (SELECT event_id, list_filter([
  CASE WHEN s NOT IN ('daytrade_day', 'daytrade_night', 'swing_day', 'swing_full') THEN 'bad_session' END,
  CASE WHEN lg NOT IN ('trend', 'mean_reversion', 'tunnel', 'pattern') THEN 'bad_logic' END,
  CASE WHEN tf NOT IN ('1min', '5min', '15min', '30min', '60min', '1d') THEN 'bad_timeframe' END,
  CASE WHEN lg IN ('pattern') THEN 'disabled_logic' END,
  CASE WHEN conf < 0.7 THEN 'low_confidence' END], lambda x: x IS NOT NULL) AS rs FROM i)
SELECT event_id, array_to_string(rs, ',') AS reasons, len(rs) = 0 AS accepted FROM r"""


def prompt_blocks_q() -> str:
    return f"""WITH {DEV},
t AS (SELECT *, row_number() OVER (PARTITION BY logic_type ORDER BY sharpe DESC, id) AS r FROM dev)
SELECT logic_type, string_agg(printf('### Strategy %d' || chr(10) || '- session: %d' || chr(10) || '- sharpe: %.1f' || chr(10),
  id, trading_session, sharpe), chr(10) ORDER BY r) AS block FROM t WHERE r <= 3 GROUP BY logic_type"""


def embedding_texts_q() -> str:
    meta = ("substring(concat_ws(' | ', 'lang=' || lang, 'source=' || source, 'chars=' || CAST(n_chars AS VARCHAR)), 1, 200)")
    sem = "concat_ws(chr(10), 'source: ' || source, text)"
    return f"""SELECT doc_id, {meta} AS metadata_text, CAST(length({sem}) AS INTEGER) AS semantic_chars,
  sha256({sem}) AS semantic_hash FROM documents"""


def failure_convergence_q() -> str:
    return f"""WITH {VLOG},
f AS (SELECT *, row_number() OVER (ORDER BY created_at, log_id) - 1 AS o FROM vp WHERE NOT passed),
p AS (SELECT *, row_number() OVER (PARTITION BY error_pattern ORDER BY o) AS n FROM f),
o50 AS (SELECT error_pattern, o AS o50 FROM p WHERE n = 50)
SELECT f.error_pattern AS pattern, count_if(f.o > o50.o50 AND f.o <= o50.o50 + 100) AS repeats_in_next,
  count_if(f.o > o50.o50 AND f.o <= o50.o50 + 100) < 10 AS converged
FROM f JOIN o50 ON o50.error_pattern = f.error_pattern GROUP BY f.error_pattern"""


# --------------------------------------------------------------------------
# intraday (5-minute day-session bars)
# --------------------------------------------------------------------------

def _bars5() -> str:
    b = bin_expr("5min")
    return f"""{MINUTE_BARS},
b5a AS (SELECT symbol, {b} AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, ts) AS close FROM minute_bars GROUP BY symbol, {b}),
b5 AS (SELECT *, CAST(ts AS DATE) AS trading_day FROM b5a WHERE {_is_day('ts')}),
dt AS (SELECT symbol, trading_day, arg_min(open, ts) AS opend, max(high) AS highd, min(low) AS lowd,
  arg_max(close, ts) AS closed FROM b5 GROUP BY 1, 2),
dl AS (SELECT *, lag(closed, 1) OVER w AS closed1, lag(closed, 2) OVER w AS closed2, lag(closed, 3) OVER w AS closed3,
  lag(highd, 1) OVER w AS highd1, lag(highd, 2) OVER w AS highd2, lag(lowd, 1) OVER w AS lowd1,
  lag(lowd, 2) OVER w AS lowd2, lag(opend, 2) OVER w AS opend2 FROM dt WINDOW w AS (PARTITION BY symbol ORDER BY trading_day)),
df AS (SELECT *, (closed1 + closed2 + closed3) / 3 AS dcavg3,
  greatest(25.0, abs(greatest(closed1, closed2, closed3) - least(closed1, closed2, closed3))) AS distance,
  greatest(50.0, greatest(highd1, highd2) - least(lowd1, lowd2)) AS hhll,
  greatest(25.0, abs(opend2 - closed1)) AS dis FROM dl)"""


def prior_day_features_q() -> str:
    cols = ["closed1", "closed2", "closed3", "highd1", "highd2", "lowd1", "lowd2", "opend2", "opend0", "dcavg3",
            "distance", "hhll", "dis"]
    return rounded(f"""WITH {_bars5()}
SELECT b.symbol, b.ts, d.closed1, d.closed2, d.closed3, d.highd1, d.highd2, d.lowd1, d.lowd2, d.opend2,
  d.opend AS opend0, d.dcavg3, d.distance, d.hhll, d.dis, coalesce(d.dis / d.hhll > 0.333, false) AS condition30
FROM b5 b LEFT JOIN df d ON d.symbol = b.symbol AND d.trading_day = b.trading_day""", cols)


def intraday_counters_q() -> str:
    wd = "(PARTITION BY symbol, trading_day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return rounded(f"""WITH {_bars5()},
x AS (SELECT *, lag(high) OVER (PARTITION BY symbol ORDER BY ts) AS h1, lag(low) OVER (PARTITION BY symbol ORDER BY ts) AS l1 FROM b5)
SELECT symbol, ts, CAST(row_number() OVER (PARTITION BY symbol, trading_day ORDER BY ts) AS INTEGER) AS k,
  max(high) OVER {wd} AS highd0, min(low) OVER {wd} AS lowd0,
  sum(coalesce(CAST(high > h1 AS INTEGER), 0)) OVER {wd} AS n_hh,
  sum(coalesce(CAST(low < l1 AS INTEGER), 0)) OVER {wd} AS n_ll FROM x""", ["highd0", "lowd0"])


def breakout_entries_q() -> str:
    wd = "(PARTITION BY symbol, trading_day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return rounded(f"""WITH {_bars5()},
x0 AS (SELECT *, lag(high) OVER ws AS h1, lag(low) OVER ws AS l1, lag(close) OVER ws AS c1
  FROM b5 WINDOW ws AS (PARTITION BY symbol ORDER BY ts)),
x AS (SELECT *, row_number() OVER (PARTITION BY symbol, trading_day ORDER BY ts) AS k,
  max(high) OVER {wd} AS highd0, min(low) OVER {wd} AS lowd0,
  sum(coalesce(CAST(high > h1 AS INTEGER), 0)) OVER {wd} AS n_hh,
  sum(coalesce(CAST(low < l1 AS INTEGER), 0)) OVER {wd} AS n_ll,
  lead(ts) OVER wn AS nts, lead(open) OVER wn AS nopen, lead(high) OVER wn AS nhigh, lead(low) OVER wn AS nlow
  FROM x0 WINDOW wn AS (PARTITION BY symbol, trading_day ORDER BY ts)),
y AS (SELECT x.*, d.*EXCLUDE (symbol, trading_day), coalesce(d.dis / d.hhll > 0.333, false) AS c30 FROM x
  LEFT JOIN df d ON d.symbol = x.symbol AND d.trading_day = x.trading_day),
z AS (SELECT *, CASE
  WHEN coalesce(k > 1 AND k < 58 AND high > closed1 + distance * 0.8 AND (low + close) / 2 > greatest(opend, dcavg3)
    AND opend > closed1 - distance * 0.6 AND close > c1
    AND low > CASE WHEN c30 THEN 0.0 ELSE greatest(highd1, highd2) END, false) THEN 1
  WHEN coalesce(k > 1 AND k < 58 AND low < closed1 - distance * 0.6 AND (high + close) / 2 < least(opend, dcavg3)
    AND opend < closed1 + distance * 0.8 AND close < c1
    AND high < CASE WHEN c30 THEN 9999999.0 ELSE least(lowd1, lowd2) END, false) THEN -1 ELSE 0 END AS side FROM y),
o AS (SELECT *, CASE side WHEN 1 THEN CASE WHEN n_hh >= k * 0.5 THEN 2 ELSE 1 END
    WHEN -1 THEN CASE WHEN n_ll >= k * 0.5 THEN 2 ELSE 1 END END AS qty,
  CASE side WHEN 1 THEN CASE WHEN k > 30 OR c30 THEN highd0 ELSE high END
    WHEN -1 THEN CASE WHEN k > 30 OR c30 THEN lowd0 ELSE low END END AS stop FROM z WHERE side <> 0),
f AS (SELECT *, CASE WHEN side = 1 THEN greatest(stop, nopen) ELSE least(stop, nopen) END AS entry_price FROM o
  WHERE (side = 1 AND nhigh >= stop) OR (side = -1 AND nlow <= stop))
SELECT symbol, trading_day, ts AS order_ts, nts AS entry_ts, CAST(side AS INTEGER) AS side, CAST(qty AS INTEGER) AS qty,
  entry_price, CAST(k AS INTEGER) AS k FROM f
QUALIFY row_number() OVER (PARTITION BY symbol, trading_day ORDER BY ts) = 1""", ["entry_price"])


def recent_failures_q() -> str:
    return f"""WITH {CALLS}
SELECT call_id, request, provider, created_at FROM calls WHERE NOT success
ORDER BY created_at DESC, call_id DESC LIMIT 20"""


def wfa_segment_metrics_q() -> str:
    K = "symbol, k, segment, combo_idx"
    secs = "((epoch_us(t1) - epoch_us(t0)) / 1e6)"
    return f"""{_wfa_core()},
sm0 AS (SELECT {K}, count(*) AS n_bars, min(ts) AS t0, max(ts) AS t1, arg_max(equity, ts) AS final_equity,
  avg(ret) AS mr, stddev_samp(ret) AS sr, min(drawdown) AS mdd, count(trade_pnl) AS total_trades,
  sum(CASE WHEN trade_pnl > 0 THEN trade_pnl END) AS gp, sum(CASE WHEN trade_pnl < 0 THEN trade_pnl END) AS gl
  FROM led GROUP BY {K}),
sm1 AS (SELECT *, CASE WHEN n_bars < 2 THEN 245.0 ELSE 31557600.0 / ({secs} / (n_bars - 1)) END AS freq FROM sm0)
SELECT s.symbol, kp.window_idx, s.segment, s.combo_idx, g.fast_period, g.slow_period,
  round(CASE WHEN sr IS NULL THEN NULL WHEN sr = 0 THEN 0.0 ELSE (mr - 0.015 / freq) / sr * sqrt(freq) END, 6) AS sharpe,
  round(abs(coalesce(mdd, 0.0)), 6) AS max_drawdown,
  round(CASE WHEN abs(coalesce(gl, 0)) = 0 THEN (CASE WHEN coalesce(gp, 0) > 0 THEN 'inf'::DOUBLE ELSE 0.0 END)
       ELSE coalesce(gp, 0) / abs(gl) END, 6) AS profit_factor,
  total_trades, round(final_equity, 2) AS final_equity, n_bars
FROM sm1 s JOIN kept kp ON kp.symbol = s.symbol AND kp.k = s.k JOIN grid g ON g.combo_idx = s.combo_idx"""


def sample_examples_q() -> str:
    return f"""WITH {DEV}
SELECT id, logic_type, sharpe FROM dev ORDER BY (logic_type = 3) DESC, md5('42' || CAST(id AS VARCHAR)) LIMIT 5"""


STRATEGY_SIGNALS = [("RSI_Reversal", "rsi_reversal"), ("DualEMACrossover", "dual_ema_cross"),
                    ("DualEMA_ATR_Trend", "dual_ema_atr_trend"), ("EMA_ADX_Trend", "ema_adx"),
                    ("MACD_MA_Trend", "macd_ma_trend"), ("MACD_RSI_Trend", "macd_rsi_trend"),
                    ("MACD_TrendConfirm", "macd_trend_confirm"), ("TrendBreakout", "trend_breakout"),
                    ("TrendCatcher", "trend_catcher"), ("TrendFilteredEMA", "trend_filtered_ema"),
                    ("MA_Cross", "ma_cross")]


def strategy_backtests_q() -> str:
    import sys
    mod = sys.modules[__name__]
    sigs = "\n  UNION ALL ".join(f"SELECT '{n}' AS strategy, symbol, ts, signal FROM ({getattr(mod, f'sig_{f}_q')()})"
                               for n, f in STRATEGY_SIGNALS)
    K = "strategy, symbol"
    secs = "((epoch_us(t1) - epoch_us(t0)) / 1e6)"
    reasons = """list_filter([
      CASE WHEN sharpe < 1.2 THEN printf('Sharpe %.2f < 1.2', sharpe) END,
      CASE WHEN max_drawdown > 0.35 THEN printf('MaxDD %.1f%% > 35%%', max_drawdown * 100) END,
      CASE WHEN profit_factor < 1.0 THEN printf('PF %.2f < 1.0', profit_factor) END,
      CASE WHEN total_trades < 80 THEN printf('Trades %d < 80', total_trades) END], lambda x: x IS NOT NULL)"""
    return f"""WITH {DAY_BARS},
allsig AS ({sigs}),
sig AS (SELECT a.strategy, a.symbol, a.ts, a.signal, d.close FROM allsig a JOIN day_bars d ON d.symbol = a.symbol AND d.ts = a.ts),
{ledger('sig', K, 'ts')},
m0 AS (SELECT {K}, count(*) AS n_bars, min(ts) AS t0, max(ts) AS t1, arg_min(equity, ts) AS e0,
  arg_max(equity, ts) AS final_equity, avg(ret) AS mr, stddev_samp(ret) AS sr, min(drawdown) AS mdd,
  count(trade_pnl) AS total_trades, sum(CASE WHEN trade_pnl > 0 THEN trade_pnl END) AS gp,
  sum(CASE WHEN trade_pnl < 0 THEN trade_pnl END) AS gl, count(CASE WHEN trade_pnl > 0 THEN 1 END) AS nw,
  avg(CASE WHEN trade_pnl > 0 THEN trade_pnl END) AS aw, avg(CASE WHEN trade_pnl < 0 THEN trade_pnl END) AS al
  FROM led GROUP BY {K}),
m1 AS (SELECT *, CASE WHEN n_bars < 2 THEN 245.0 ELSE 31557600.0 / ({secs} / (n_bars - 1)) END AS freq,
  floor({secs} / 86400) / 365.25 AS years FROM m0),
met AS (SELECT {K},
  CASE WHEN sr IS NULL THEN NULL WHEN sr = 0 THEN 0.0 ELSE (mr - 0.015 / freq) / sr * sqrt(freq) END AS sharpe,
  abs(coalesce(mdd, 0.0)) AS max_drawdown,
  CASE WHEN abs(coalesce(gl, 0)) = 0 THEN (CASE WHEN coalesce(gp, 0) > 0 THEN 'inf'::DOUBLE ELSE 0.0 END)
       ELSE coalesce(gp, 0) / abs(gl) END AS profit_factor,
  coalesce(nw / nullif(total_trades, 0), 0.0) AS win_rate, total_trades,
  CASE WHEN n_bars < 2 OR e0 = 0 THEN 0.0 WHEN years <= 0 THEN 0.0 WHEN final_equity / e0 < 0 THEN NULL
       ELSE pow(final_equity / e0, 1.0 / years) - 1 END AS annual_return,
  coalesce(aw, 0.0) AS avg_win, coalesce(al, 0.0) AS avg_loss, final_equity, n_bars FROM m1),
scr AS (SELECT *, array_to_string({reasons}, '; ') AS reasons, len({reasons}) = 0 AS passed FROM met)
SELECT strategy, symbol, round(sharpe, 6) AS sharpe, round(max_drawdown, 6) AS max_drawdown,
  round(profit_factor, 6) AS profit_factor, round(win_rate, 6) AS win_rate, total_trades,
  round(annual_return, 6) AS annual_return, round(avg_win, 2) AS avg_win, round(avg_loss, 2) AS avg_loss,
  round(final_equity, 2) AS final_equity, n_bars, reasons, passed,
  CASE WHEN passed THEN 'reviewing' ELSE 'draft' END AS status FROM scr"""


def price_jumps_q() -> str:
    return f"""SELECT symbol, ts, prev_close FROM ({bar_flags_q()}) WHERE is_jump"""


def recall_at_5_q() -> str:
    return f"SELECT n_cases, recall_at_5 FROM ({retrieval_eval_q()})"


def mrr_q() -> str:
    return f"SELECT n_cases, mrr FROM ({retrieval_eval_q()})"


def page_title_q() -> str:
    return f"SELECT page_id, title, title_or_url FROM ({page_title_text_q()})"


def page_text_q() -> str:
    return f"SELECT page_id, text, n_chars FROM ({page_title_text_q()})"


def fenced_block_q() -> str:
    fj = _dedent_strip_sql("regexp_extract(output, '(?is)```json\\s*\\n(.*?)```', 1)")
    fb = _dedent_strip_sql("regexp_extract(output, '(?s)```\\s*\\n(.*?)```', 1)")
    return f"""WITH {OUTPUTS},
b AS (SELECT conv_id, turn, coalesce(nullif({fj}, ''), nullif({fb}, ''), '') AS block FROM o1)
SELECT conv_id, turn, CAST(length(block) AS INTEGER) AS block_chars, sha256(block) AS block_hash FROM b"""


def session_rules_daytrade_day_q() -> str:
    s = sod("ts")
    return f"""WITH {_bars5()},
{ma_cross_signals('b5', 'symbol', 'ts', 5, 20)}
SELECT symbol, ts, CAST(signal AS INTEGER) AS signal,
  CAST(CASE WHEN {s} >= 31500 AND {s} < 48300 THEN signal ELSE 0 END AS INTEGER) AS entry_signal,
  {s} = 49140 AS exit_marker FROM sig"""


def find_similar_trend_q() -> str:
    return f"""WITH {DEV},
c AS (SELECT * FROM dev WHERE logic_type = 3 AND NOT overfitting_flag),
p AS (SELECT q.id AS qid, c.id AS id, list_cosine_similarity(q.sem, c.sem) AS similarity
  FROM dev q JOIN c ON q.id <> c.id WHERE q.logic_type = 3),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS INTEGER) AS rank FROM p)
SELECT qid, rank, id, round(similarity, 6) AS similarity, round(1.0 - similarity, 6) AS distance FROM r WHERE rank <= 3"""


def stop_limits_q() -> str:
    return f"""WITH {DEV},
x AS (SELECT id, CASE WHEN trading_session < 2 THEN 'daytrade' ELSE 'swing' END AS holding_type,
  CAST((id * 7) % 300 AS DOUBLE) AS stop_points FROM dev)
SELECT *, coalesce(stop_points <= CASE holding_type WHEN 'daytrade' THEN 150.0 WHEN 'swing' THEN 250.0 END, false)
  AS within_limit FROM x"""


def fail_records_q() -> str:
    return f"""WITH {VLOG}
SELECT v.log_id, chr(10) || '## ' || strftime(e.ts, '%Y-%m-%d %H:%M') || ' ' || e.event_type || ' / '
  || CASE WHEN v.layer = 1 THEN 'long' ELSE 'both' END || ' / 1min' || chr(10) || '- 策略：' || CAST(v.strategy_id AS VARCHAR) || chr(10)
  || '- 設計摘要：' || v.message || chr(10) || '- 失敗：' || v.error_pattern || '、layer ' || CAST(v.layer AS VARCHAR) || chr(10) AS record
FROM vp v JOIN events e ON e.event_id = v.log_id WHERE NOT v.passed"""


def critique_checks_q() -> str:
    return """SELECT conv_id, turn,
  coalesce(turn / 10.0 >= 0.7 AND conv_id % 2 = 0 AND contains(text, 'a')
    AND NOT contains(lower(text), 'volume')
    AND (['good', 'acceptable', 'poor'])[conv_id % 3 + 1] IN ('good', 'acceptable')
    AND length(text) > 100, false) AS passed
FROM conversations WHERE role = 'assistant'"""


def knowledge_listing_q() -> str:
    host = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1))"
    return f"""SELECT page_id AS id, url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title,
  CAST(length(html) AS INTEGER) AS content_length, TIMESTAMP '2024-01-01 00:00:00' AS added_at
FROM pages WHERE NOT starts_with({host}, 'm.')"""


def collection_upsert_q() -> str:
    return """WITH d AS (SELECT vec_id AS id, label AS logic_type, embedding AS vec FROM embeddings),
n AS (SELECT vec_id AS id, label AS logic_type, list_reverse(embedding) AS vec FROM embeddings
  WHERE label = 9 AND len(embedding) = 64),
u AS (SELECT * FROM n UNION ALL SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.id = d.id))
SELECT id, logic_type, CAST(len(vec) AS INTEGER) AS dim, round(CAST(vec[1] AS DOUBLE), 6) AS first_component FROM u"""


def minute_table_q() -> str:
    s = sod("b.ts")
    return rounded(f"""WITH {MINUTE_BARS},
dd0 AS (SELECT symbol, CAST(ts AS DATE) AS date, bool_or({_is_day()}) AS has_day FROM minute_bars GROUP BY 1, 2),
dd AS (SELECT *, min(CASE WHEN has_day THEN date END) OVER (PARTITION BY symbol ORDER BY date
       ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_day FROM dd0),
t AS (SELECT b.symbol, b.ts, b.open, b.high, b.low, b.close,
  CASE WHEN {_is_day('b.ts')} THEN CAST(b.ts AS DATE)
       WHEN {s} >= 54000 AND {s} <= 86399 THEN d.next_day
       WHEN {s} <= 18000 THEN CASE WHEN d.has_day THEN CAST(b.ts AS DATE) ELSE coalesce(d.next_day, CAST(b.ts AS DATE)) END
  END AS trading_day, {_classify('b.ts')} AS session_type
  FROM minute_bars b LEFT JOIN dd d ON d.symbol = b.symbol AND d.date = CAST(b.ts AS DATE))
SELECT *, strftime(trading_day, '%Y-%m') AS trading_day_month FROM t""", RES_COLS)


def bar_files_q() -> str:
    return rounded(f"""WITH {MINUTE_BARS}
SELECT symbol, ts, open, high, low, close FROM minute_bars""", RES_COLS)


def bar_file_range_q() -> str:
    return f"""WITH {MINUTE_BARS},
h AS (SELECT strftime(ts, '%Y/%m/%d') AS d, ts FROM minute_bars WHERE length(symbol) % 2 = 1)
SELECT min(d) AS start, max(d) AS end,
  count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-11') AS n_rows,
  min(d) FILTER (WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-11') AS first FROM h"""


def retrieve_bundle_q() -> str:
    picks = diversity_filter_q(0.85)
    return f"""WITH {DEV}, fail AS (SELECT * FROM dev WHERE logic_type = 9),
good AS (SELECT qid, id, pick FROM ({picks})),
few AS (SELECT * FROM (SELECT id, trading_session, md5('42' || CAST(id AS VARCHAR)) AS draw,
  row_number() OVER (PARTITION BY trading_session ORDER BY md5('42' || CAST(id AS VARCHAR)), id) AS r FROM dev) WHERE r <= 7),
spare AS (SELECT q.id AS qid, f.id, f.draw FROM dev q JOIN few f ON f.trading_session = q.trading_session AND f.id <> q.id
  WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.qid = q.id AND g.id = f.id)),
u AS (SELECT qid, id, 0 AS src, pick, '' AS draw FROM good UNION ALL SELECT qid, id, 1, NULL, draw FROM spare),
p AS (SELECT qid, 'positive' AS part, CAST(row_number() OVER (PARTITION BY qid ORDER BY src, pick, draw, id) AS INTEGER) AS slot, id FROM u),
n AS (SELECT q.id AS qid, 'negative' AS part, CAST(row_number() OVER (PARTITION BY q.id
  ORDER BY list_cosine_similarity(q.sem, c.sem) DESC, c.id) AS INTEGER) AS slot, c.id FROM dev q JOIN fail c ON q.id <> c.id)
SELECT * FROM p WHERE slot <= 3 UNION ALL SELECT * FROM n WHERE slot <= 2"""


_KEYWORD_CASES = f"""{DEV},
named AS (SELECT *, ['daytrade_day', 'daytrade_night', 'swing_day', 'swing_full'][trading_session + 1] AS sess,
  ['trend', 'mean_reversion', 'breakout', 'opening', 'scalp', 'pattern'][logic_type % 6 + 1] AS logic FROM dev),
cases AS (SELECT *, CASE WHEN id % 5 IN (0, 2) THEN sess END AS qs,
  CASE WHEN id % 5 IN (1, 2) THEN logic WHEN id % 5 = 4 THEN 'opening' END AS ql,
  CASE id % 5 WHEN 0 THEN [sess] WHEN 1 THEN [logic] WHEN 2 THEN [sess, logic] WHEN 3 THEN ['momentum'] ELSE ['gap', 'opening'] END AS expected
  FROM named),
hits AS (SELECT q.id AS qid, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.sem, c.sem) DESC, c.id) AS rank,
  len(list_filter(q.expected, lambda k: length(k) > 3 AND contains(c.sess || ' ' || c.logic, k))) > 0 AS hit
  FROM cases q JOIN named c ON c.id <> q.id AND (q.qs IS NULL OR c.sess = q.qs) AND (q.ql IS NULL OR c.logic = q.ql))"""


def recall_keyword_q() -> str:
    return f"""WITH {_KEYWORD_CASES},
per AS (SELECT q.id, coalesce(max(CASE WHEN h.hit AND h.rank <= 5 THEN 1 ELSE 0 END), 0) AS hit FROM cases q
  LEFT JOIN hits h ON h.qid = q.id GROUP BY q.id)
SELECT count(*) AS n_cases, round(avg(hit), 6) AS recall_at_5 FROM per"""


def mrr_keyword_q() -> str:
    return f"""WITH {_KEYWORD_CASES},
per AS (SELECT q.id, coalesce(1.0 / min(CASE WHEN h.hit AND h.rank <= 20 THEN h.rank END), 0) AS rr FROM cases q
  LEFT JOIN hits h ON h.qid = q.id GROUP BY q.id)
SELECT count(*) AS n_cases, round(avg(rr), 6) AS mrr FROM per"""


# --------------------------------------------------------------------------
# fills at opens and forced exits (row-by-row recursion)
# --------------------------------------------------------------------------

def open_ledger(src: str) -> str:
    """CTEs ending in ``led``: the recursion over ``src`` (symbol, rn, ts, open, close,
    ord: the target that this bar's open settles, forced)."""
    new = "coalesce(s.ord, r.pos)"
    opens, closes = f"{new} <> r.pos AND {new} <> 0", f"{new} <> r.pos AND r.pos <> 0"
    return rec_cte("led", src, [
        ("ts", "s.ts", "s.ts"), ("open", "s.open", "s.open"), ("close", "s.close", "s.close"),
        ("pos", "coalesce(s.ord, 0)", new), ("prev", "0", "r.pos"),
        ("ep", "CASE WHEN coalesce(s.ord, 0) <> 0 THEN s.open END", f"CASE WHEN {opens} THEN s.open ELSE r.ep END"),
        ("et", "CASE WHEN coalesce(s.ord, 0) <> 0 THEN s.ts END", f"CASE WHEN {opens} THEN s.ts ELSE r.et END"),
        ("ep0", "CAST(NULL AS DOUBLE)", "r.ep"), ("et0", "CAST(NULL AS TIMESTAMP)", "r.et"),
        ("forced", "false", f"s.forced AND {closes}"),
        ("pnl", "CAST(NULL AS DOUBLE)", f"CASE WHEN {closes} THEN (s.open - r.ep) * r.pos * 200.0 - 600.0 END"),
        ("eq", "CAST(500000.0 + 200.0 * coalesce(s.ord, 0) * (s.close - s.open) - CASE WHEN coalesce(s.ord, 0) <> 0 THEN 300.0 ELSE 0 END AS DOUBLE)",
         f"r.eq + 200.0 * (r.pos * (s.open - r.close) + {new} * (s.close - s.open)) - CASE WHEN {opens} THEN 300.0 ELSE 0 END "
         f"- CASE WHEN {closes} THEN 600.0 ELSE 0 END"),
    ])


def trade_list_open_q() -> str:
    return f"""WITH RECURSIVE {DAY_BARS},
{ma_cross_signals('day_bars', 'symbol', 'ts', 20, 60)},
src AS (SELECT symbol, ts, open, close, CAST(nullif(signal, 0) AS INTEGER) AS ord, false AS forced,
  row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn FROM sig),
{open_ledger('src')}
SELECT symbol, et0 AS entry_ts, ts AS exit_ts, CAST(prev AS INTEGER) AS side, round(ep0, 2) AS entry_price,
  round(open, 2) AS exit_price, round(pnl, 2) AS pnl FROM led WHERE pnl IS NOT NULL"""


def _session_core() -> str:
    s = sod("ts")
    day_flat = "CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 820 MINUTE"
    night_flat = (f"CASE WHEN {s} >= 54000 THEN CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) + INTERVAL 285 MINUTE "
                  "ELSE CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 285 MINUTE END")
    return f"""WITH RECURSIVE {MINUTE_BARS},
v AS (SELECT 'daytrade_day|' || symbol AS symbol, ts, open, close, {s} >= 31500 AND {s} < 48300 AS may_open, {day_flat} AS flat
      FROM minute_bars WHERE {_is_day()}
      UNION ALL
      SELECT 'daytrade_night|' || symbol, ts, open, close, ({s} >= 54000 AND {s} <= 86399) OR {s} < 15900, {night_flat}
      FROM minute_bars WHERE {_is_night()}),
{ma_cross_signals('v', 'symbol', 'ts', 5, 20)},
nx AS (SELECT *, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS nts FROM sig),
ex AS (SELECT *, ts < flat AND (nts IS NULL OR nts >= flat) AS mark FROM nx),
ox AS (SELECT *, coalesce(lag(mark) OVER (PARTITION BY symbol ORDER BY ts), false) AS forced FROM ex),
src AS (SELECT symbol, ts, open, close, flat, forced,
  CAST(CASE WHEN forced THEN 0 WHEN may_open THEN nullif(signal, 0) END AS INTEGER) AS ord,
  row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn FROM ox),
{open_ledger('src')}"""


def session_trades_q() -> str:
    return f"""{_session_core()}
SELECT split_part(symbol, '|', 1) AS session_class, split_part(symbol, '|', 2) AS symbol, et0 AS entry_ts, ts AS exit_ts,
  CAST(prev AS INTEGER) AS side, round(ep0, 2) AS entry_price, round(open, 2) AS exit_price, round(pnl, 2) AS pnl, forced
FROM led WHERE pnl IS NOT NULL"""


def session_backtest_q() -> str:
    return f"""{_session_core()},
pk AS (SELECT l.*, s.flat, max(eq) OVER (PARTITION BY l.symbol ORDER BY l.rn {RUN}) AS peak
  FROM led l JOIN src s ON s.symbol = l.symbol AND s.rn = l.rn)
SELECT split_part(symbol, '|', 1) AS session_class, split_part(symbol, '|', 2) AS symbol, count(*) AS n_bars,
  count(pnl) AS n_trades, CAST(count_if(forced) AS BIGINT) AS n_forced,
  CAST(count_if(pos <> 0 AND ts >= flat) AS BIGINT) AS n_held_past_flat, round(sum(pnl), 2) AS pnl,
  round(arg_max(eq, rn), 2) AS final_equity, round(min((eq - peak) / peak), 6) AS max_drawdown
FROM pk GROUP BY 1, 2"""


def approx_recall_q() -> str:
    """What the index must reach: every query has its ten neighbours, nine in ten found."""
    return f"""WITH {DEV},
n AS (SELECT count(*) AS n FROM dev)
SELECT count(*) AS n_queries, CAST(sum(least(10, n - 1)) AS BIGINT) AS n_neighbours, true AS recall_reached
FROM dev, n WHERE id % 20 = 0"""


# --------------------------------------------------------------------------
# stored tables
# --------------------------------------------------------------------------

DELIVERIES = """dl AS (SELECT o_orderpriority AS symbol, o_orderdate AS ts, o_orderstatus AS delivery,
  arg_min(o_totalprice, o_orderkey) AS open, max(CASE WHEN o_custkey % 5 <> 0 THEN o_totalprice END) AS high,
  min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close
  FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' GROUP BY 1, 2, 3),
good AS (SELECT * FROM dl WHERE high >= low AND open > 0 AND close IS NOT NULL),
new AS (SELECT symbol, ts, open, high, low, close FROM good
  QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY delivery DESC) = 1),
tab AS (SELECT * FROM new UNION ALL SELECT d.* FROM day_bars d
  WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.symbol = d.symbol AND n.ts = d.ts))"""


def stored_upsert_q() -> str:
    return rounded(f"WITH {DAY_BARS}, {DELIVERIES} SELECT *, CAST(year(ts) AS INTEGER) AS year FROM tab", RES_COLS)


def stored_upsert_report_q() -> str:
    return f"""WITH {DAY_BARS}, {DELIVERIES},
n AS (SELECT CAST(year(ts) AS INTEGER) AS year, count(*) AS n_bars FROM tab GROUP BY 1),
b AS (SELECT CAST(year(ts) AS INTEGER) AS year, count(*) AS n FROM dl WHERE high IS NULL OR high < low OR open <= 0 GROUP BY 1),
t AS (SELECT DISTINCT CAST(year(ts) AS INTEGER) AS year FROM new)
SELECT n.year, n.n_bars, coalesce(b.n, 0) AS n_rejected, t.year IS NOT NULL AS rewritten
FROM n LEFT JOIN b ON b.year = n.year LEFT JOIN t ON t.year = n.year"""


def minute_table_range_q() -> str:
    return f"""SELECT symbol, ts, open, high, low, close, trading_day, session_type FROM ({minute_table_q()}) mt
WHERE symbol = 'click' AND trading_day BETWEEN DATE '2024-01-25' AND DATE '2024-02-05'"""


def collection_rejects_q() -> str:
    return """SELECT vec_id AS id, 'vector length 32 != 64' AS reject_reason, CAST(len(embedding) AS INTEGER) AS stored_dim,
  round(CAST(embedding[1] AS DOUBLE), 6) AS first_component FROM embeddings WHERE label = 9 AND vec_id % 7 = 0"""


def collection_counts_q() -> str:
    def part(step: str, keep: str) -> str:
        return " UNION ALL ".join(f"SELECT '{step}' AS step, '{name}' AS filter, count(*) AS n FROM embeddings WHERE {keep} AND {cond}"
                                  for name, cond in (("all", "true"), ("logic_type = 3", "label = 3"), ("logic_type < 5", "label < 5")))
    return f"{part('stored', 'true')} UNION ALL {part('type 3 cleared', 'label <> 3')} UNION ALL {part('cleared', 'false')}"


# --------------------------------------------------------------------------
# holding times
# --------------------------------------------------------------------------

def _held() -> str:
    return f"""{_ma_ledger()},
e1 AS (SELECT *, last_value(CASE WHEN chg THEN ts END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts {RUN}) AS ets FROM led),
e2 AS (SELECT *, lag(ets) OVER (PARTITION BY symbol ORDER BY ts) AS ets_prev FROM e1),
held AS (SELECT symbol, CAST(floor((epoch_us(ts) - epoch_us(ets_prev)) / 60e6) AS BIGINT) AS minutes FROM e2 WHERE trade_pnl IS NOT NULL)"""


def holding_time_buckets_q() -> str:
    return f"""{_held()}
SELECT symbol, CAST(CASE WHEN minutes >= 129600 THEN 129600 WHEN minutes >= 43200 THEN 43200 WHEN minutes >= 20160 THEN 20160
  WHEN minutes >= 10080 THEN 10080 WHEN minutes >= 1440 THEN 1440 ELSE 0 END AS BIGINT) AS bucket, count(*) AS n_trades
FROM held GROUP BY 1, 2"""


def holding_time_quantiles_q() -> str:
    """What a sketch must reach: each quantile of each symbol within its error."""
    return f"""{_held()}
SELECT DISTINCT symbol, q.quantile, true AS rank_within_error
FROM held, (VALUES (CAST(0.1 AS DOUBLE)), (0.25), (0.5), (0.75), (0.9)) q(quantile)"""


# --------------------------------------------------------------------------
# report files, strategy library
# --------------------------------------------------------------------------

def report_numbers_q() -> str:
    t, three = "CAST(k AS VARCHAR)", "lpad(CAST(k % 1000 AS VARCHAR), 3, '0')"
    return f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_orderkey * 7 + l_linenumber AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE k % 9 WHEN 0 THEN '$1,' || {three} WHEN 1 THEN '($2,' || {three} || ')'
  WHEN 2 THEN '-' || {t} || '.5%' WHEN 3 THEN '—' WHEN 4 THEN 'N/A' WHEN 5 THEN '-$' || {t} WHEN 6 THEN '"' || {t} || '"'
  WHEN 7 THEN {t} || ' 000' ELSE '(' || {t} || '%)' END AS raw,
  CAST(CASE k % 9 WHEN 0 THEN 1000 + k % 1000 WHEN 1 THEN -2000 - k % 1000 WHEN 2 THEN -k - 0.5 WHEN 6 THEN k WHEN 8 THEN -k END AS DOUBLE) AS value
FROM x"""


def report_files_q() -> str:
    return """SELECT s_suppkey AS strategy,
  CAST(CASE WHEN s_suppkey % 5 = 0 THEN -1 ELSE 1 END * ((s_suppkey * 12345) % 2000000) AS DOUBLE) AS total_net_profit,
  round(s_suppkey % 4 + (s_suppkey % 100) / 100.0, 6) AS profit_factor,
  CASE WHEN s_suppkey % 4 <> 1 THEN round((s_suppkey % 60 + 0.5) / 100, 6) ELSE 0.0 END AS max_drawdown_pct,
  CAST(-(s_suppkey * 100 + 1000) AS DOUBLE) AS max_drawdown_abs, s_suppkey % 91 + 60 AS total_trades,
  CASE WHEN s_suppkey % 2 = 0 THEN round((s_suppkey % 90 + 0.25) / 100, 6)
       ELSE round((s_suppkey % 50 + 1) / (s_suppkey % 91 + 60), 6) END AS win_rate,
  CASE WHEN s_suppkey % 7 <> 0 THEN round(s_suppkey % 3 + (s_suppkey % 10) / 10.0, 6) END AS sharpe_ratio,
  CASE WHEN s_suppkey % 7 = 0 THEN 'sharpe_ratio' ELSE '' END AS missing FROM supplier"""


LIBRARY = """lb AS (SELECT s_suppkey AS i, s_name, f.folder, 'S' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS stem,
  CASE WHEN s_suppkey % 11 = 0 THEN 'scalp' WHEN f.folder = 'Daytrade' THEN 'daytrade' ELSE 'swing' END AS holding_type,
  CASE WHEN s_suppkey % 6 = 5 THEN 'momentum'
       ELSE ['trend', 'mean_reversion', 'breakout', 'pattern', 'tunnel'][s_suppkey % 5 + 1] END AS category,
  'Inputs: n(' || CAST(s_suppkey AS VARCHAR) || '); { 策略 }' || chr(10) || 'Buy Next Bar at Market;' || chr(10) AS code
  FROM supplier, (VALUES ('Daytrade'), ('Swing')) f(folder)),
lr AS (SELECT *, CASE WHEN i % 13 = 0 AND folder = 'Daytrade' THEN 'no script file' WHEN i % 9 = 0 THEN 'missing: direction'
  WHEN i % 11 = 0 THEN 'bad holding_type: scalp' END AS reject_reason FROM lb)"""


def strategy_library_q() -> str:
    return f"""WITH {LIBRARY}
SELECT folder, stem, holding_type, category, category = 'momentum' AS unknown_category, 'stop,flat' AS risk_features,
  CAST(length(code) AS INTEGER) AS code_chars, true AS code_decoded, reject_reason FROM lr WHERE reject_reason IS NULL
UNION ALL SELECT folder, stem, NULL, NULL, NULL, NULL, NULL, NULL, reject_reason FROM lr WHERE reject_reason IS NOT NULL"""


def strategy_texts_q() -> str:
    d = "s_name || ' in ' || folder"
    return f"""WITH {LIBRARY}
SELECT folder, stem, '類型: ' || holding_type || ' ' || category || chr(10) || '時間框架: 5min' || chr(10) || '方向: both' || chr(10)
  || '概要: ' || substring({d}, 1, 50) AS metadata_text,
  {d} || chr(10) || '備註: n' || CAST(i AS VARCHAR) AS semantic_text, sha256(code) AS code_hash
FROM lr WHERE reject_reason IS NULL"""


def library_index_q() -> str:
    return f"""WITH {LIBRARY}, ok AS (SELECT * FROM lr WHERE reject_reason IS NULL),
n AS (SELECT count(*) AS every, count(*) FILTER (folder = 'Swing') AS swing FROM ok)
SELECT 'dry run' AS run, every AS n_entries, 0 AS n_stored, 0 AS n_not_unit, 0 AS n_swing FROM n
UNION ALL SELECT 'rebuild', every, every, 0, swing FROM n UNION ALL SELECT 'upsert', swing, every, 0, swing FROM n"""


# --------------------------------------------------------------------------
# faulty feed, registry escapes, metric runs, tags, scripts, cascades, key figures
# --------------------------------------------------------------------------

FAULTY = """faulty AS (SELECT symbol, ts, CASE WHEN minute(ts) % 17 = 3 THEN open * 1.2 WHEN minute(ts) % 31 = 13 THEN -1.0 ELSE open END AS open,
  CASE WHEN minute(ts) % 19 = 5 THEN low - 1 ELSE high END AS high, CASE WHEN minute(ts) % 19 = 5 THEN high + 1 ELSE low END AS low,
  CASE WHEN minute(ts) % 29 <> 11 THEN close END AS close, CASE WHEN minute(ts) % 23 = 7 THEN 0 ELSE n_ticks END AS volume FROM minute_bars)"""


def _on_faulty(sql: str) -> str:
    """An oracle over the minute bars, read from the faulty feed instead."""
    head, rest = sql.split("fl0 AS (", 1)
    return f"{head}{FAULTY},\nfl0 AS ({rest.replace('FROM minute_bars)', 'FROM faulty)')}"


def faulty_price_jumps_q() -> str:
    return _on_faulty(rounded(f"WITH {FLAGGED} SELECT symbol, ts, open, prev_close FROM flagged WHERE is_jump", ["open", "prev_close"]))


def faulty_bar_report_q() -> str:
    return _on_faulty(bar_quality_report_q())


def faulty_bars_cleaned_q() -> str:
    return rounded(f"""WITH {MINUTE_BARS}, {FAULTY} SELECT symbol, ts, open, high, low, close FROM faulty
WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND high >= low AND open > 0 AND volume <> 0""", RES_COLS)


def signals_trend_breakout_prior_q() -> str:
    return sig_trend_breakout_q(prior=True)


def pandas_strategy_q() -> str:
    w_ = "(PARTITION BY symbol, date_trunc('month', ts) ORDER BY ts)"
    return f"""WITH {DAY_BARS},
r AS (SELECT *, coalesce(sign(close - lag(close, 2) OVER {w_}), 0) AS raw FROM day_bars)
SELECT symbol, ts, CAST(coalesce(lag(raw) OVER {w_}, 0) AS INTEGER) AS signal FROM r"""


def aligned_signals_q() -> str:
    return f"""WITH {DAY_BARS},
{ma_cross_signals('day_bars', 'symbol', 'ts', 20, 60)}
SELECT d.symbol, d.ts, round(d.close, 6) AS close, CAST(s.signal AS INTEGER) AS signal
FROM day_bars d JOIN sig s ON s.symbol = d.symbol AND s.ts = d.ts WHERE s.signal <> 0"""


def metric_runs_q() -> str:
    def run(phase: int, keep: str) -> str:
        return (f"SELECT 'success:' || provider AS metric_name, round(avg(CAST(success AS DOUBLE)), 6) AS value, {phase} AS phase, "
                f"max(created_at) AS created_at FROM calls_fx WHERE {keep} GROUP BY provider")
    return f"WITH {CALLS_FX} {run(1, 'call_id % 2 = 0')} UNION ALL {run(3, 'true')}"


def knowledge_context_tagged_q() -> str:
    host = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1))"
    lang = "regexp_extract(url, '://[^/]+/([a-z]{2})/', 1)"
    return f"""WITH {PAGES},
k AS (SELECT page_id AS id, url, title, text, CASE WHEN page_id % 7 <> 3 THEN upper({lang}) || ',' || {host} END AS tags,
  CASE WHEN page_id % 5 <> 0 THEN page_id % 9 <> 0 END AS fetch_ok FROM pg),
f AS (SELECT * FROM (VALUES (''), ('EN'), ('fr'), ('shop'), ('zz')) v(tag_filter)),
u AS (SELECT f.tag_filter, k.*, row_number() OVER (PARTITION BY f.tag_filter ORDER BY k.id) AS r FROM f JOIN k
  ON contains(lower(coalesce(k.tags, '')), lower(f.tag_filter)) WHERE length(k.text) > 0 AND coalesce(k.fetch_ok, true)),
c AS (SELECT tag_filter, count(*) AS n, string_agg('### [' || coalesce(title, url) || '](' || url || ')' || chr(10) || '標籤：'
  || coalesce(tags, '無') || chr(10) || substring(text, 1, 3000) || chr(10), chr(10) ORDER BY id) AS body FROM u WHERE r <= 8 GROUP BY tag_filter)
SELECT f.tag_filter, coalesce(c.n, 0) AS n_pages,
  coalesce('## 知識庫參考資料（使用者指定網址）' || chr(10) || chr(10) || c.body, '') AS context FROM f LEFT JOIN c ON c.tag_filter = f.tag_filter"""


def script_summary_q() -> str:
    code = """CASE WHEN doc_id % 2 = 0 THEN 'INPUTS: n(5);' || chr(10) ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN 'Variables: v(0);' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 5 < 3 THEN '// buy later' || chr(10) || '  Buy Next Bar at Market;' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 7 < 5 THEN 'SELL short;' || chr(10) || chr(10) ELSE '' END || coalesce(text, '')"""
    miss = ", ".join(f"CASE WHEN NOT contains(lower(code), '{w_}') THEN '{label}' END" for w_, label in (
        ("inputs", "inputs 宣告"), ("variables", "variables 宣告"), ("buy", "Buy 進場指令"), ("sell", "Sell Short 進場指令")))
    return f"""WITH x AS (SELECT doc_id, {code} AS code FROM documents)
SELECT doc_id, array_to_string(list_filter([{miss}], lambda m: m IS NOT NULL), ', ') AS missing,
  CAST(len(list_filter(list_transform(string_split(code, chr(10)), lambda l: trim(l)), lambda l: l <> '' AND NOT starts_with(l, '//'))) AS INTEGER) AS effective_lines
FROM x"""


def first_success_cascade_q() -> str:
    return f"""WITH {CALLS_FX},
o AS (SELECT *, CASE provider WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 4 END AS p FROM calls_fx),
r AS (SELECT *, row_number() OVER (PARTITION BY request, success ORDER BY p, provider, created_at, call_id) AS up,
  row_number() OVER (PARTITION BY request, success ORDER BY p DESC, provider DESC, created_at DESC, call_id DESC) AS down FROM o),
ok AS (SELECT * FROM r WHERE success AND up = 1), ko AS (SELECT * FROM r WHERE NOT success AND down = 1)
SELECT coalesce(ok.request, ko.request) AS request, ok.request IS NOT NULL AS succeeded, coalesce(ok.provider, ko.provider) AS provider,
  coalesce(ok.call_id, ko.call_id) AS call_id FROM ok FULL JOIN ko ON ko.request = ok.request"""


def kpi_overview_q() -> str:
    return f"""WITH {DEV}, x AS (SELECT *, (id % 51) / 100.0 AS dd, TIMESTAMP '2024-01-01' + to_hours(id) AS added_at FROM dev)
SELECT count(*) AS strategy_count, CAST(count_if(added_at >= (SELECT date_trunc('week', max(added_at)) FROM x)) AS BIGINT) AS this_week_added,
  round(avg(sharpe), 6) AS avg_sharpe, round(avg(dd), 6) AS max_drawdown_avg,
  CAST(count_if(overfitting_flag AND sharpe >= 1.2) AS BIGINT) AS pending_review_count, CAST(count_if(overfitting_flag) AS BIGINT) AS overfitting_count FROM x"""


def kpi_distribution_q() -> str:
    return f"""WITH {DEV} SELECT 'trading_session' AS dimension, CAST(trading_session AS VARCHAR) AS value, count(*) AS n FROM dev GROUP BY 2
UNION ALL SELECT 'logic_type', CAST(logic_type AS VARCHAR), count(*) FROM dev GROUP BY 2"""


def find_similar_records_q() -> str:
    return f"""WITH {DEV},
n AS (SELECT *, CASE WHEN trading_session < 2 THEN 'daytrade' ELSE 'swing' END AS holding,
  ['trend', 'mean_reversion', 'breakout', 'opening', 'scalp', 'pattern'][logic_type % 6 + 1] AS category FROM dev),
r AS (SELECT q.id AS qid, q.category AS q_category, q.holding AS q_holding, c.id, c.category, c.sharpe,
  list_cosine_similarity(q.sem, c.sem) AS similarity,
  CAST(row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.sem, c.sem) DESC, c.id) AS INTEGER) AS rank
  FROM n q JOIN n c ON c.category = q.category AND c.holding = q.holding AND c.id <> q.id WHERE NOT c.overfitting_flag)
SELECT qid, 'Category: ' || q_category || chr(10) || 'Holding Type: ' || q_holding || chr(10) || 'Timeframe: 5min' || chr(10) || 'Direction: both'
  || CASE WHEN qid % 3 = 0 THEN chr(10) || 'Requirements: ATR stop loss' ELSE '' END AS query, rank, id, round(similarity, 6) AS similarity,
  'S' || CAST(id AS VARCHAR) AS name, category, round(sharpe, 6) AS sharpe FROM r WHERE rank <= 2 AND id % 13 <> 0"""


def sample_examples_by_type_q() -> str:
    return f"""WITH {DEV}, t AS (SELECT DISTINCT logic_type AS target FROM dev),
r AS (SELECT t.target, d.id, d.logic_type, round(d.sharpe, 6) AS sharpe, CAST(row_number() OVER (PARTITION BY t.target
  ORDER BY (d.logic_type = t.target) DESC, md5('42' || CAST(d.id AS VARCHAR)), d.id) AS INTEGER) AS slot FROM t, dev d)
SELECT * FROM r WHERE slot <= 5"""


def recall_keyword_query_q() -> str:
    text = "CASE WHEN q.id % 10 = 3 THEN 'swing momentum entries' WHEN q.id % 10 = 8 THEN 'Momentum of the week' " \
           "WHEN q.id % 10 = 4 THEN 'fade the opening range' ELSE 'find similar' END"
    cases = _KEYWORD_CASES.replace("contains(c.sess || ' ' || c.logic, k)", f"(contains(c.sess || ' ' || c.logic, k) OR contains({text}, k))")
    return f"""WITH {cases},
per AS (SELECT q.id, coalesce(max(CASE WHEN h.hit AND h.rank <= 5 THEN 1 ELSE 0 END), 0) AS hit FROM cases q
  LEFT JOIN hits h ON h.qid = q.id GROUP BY q.id)
SELECT id % 10 AS kind, count(*) AS n_cases, round(avg(hit), 6) AS recall_at_5 FROM per GROUP BY 1"""
