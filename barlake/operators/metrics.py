"""Performance measures (D3–D10, D23–D25) as per-key aggregates.

Definitions follow the reference's metric module:

* Sharpe: bar returns of equity, sample stdev; 0 when the stdev is 0;
  ``(mean(r) - rf/freq) / std(r) · sqrt(freq)``, ``freq = 365.25·86400 /
  mean bar spacing`` (245 when fewer than two bars).  Fewer than two returns
  give NULL (pandas NaN).
* max drawdown ``|min((e - peak)/peak)|``; profit factor Σwins/|Σlosses| (+∞
  without losses but with profit, else 0); win rate counts zero-PnL trades in
  the denominator only; CAGR over whole days / 365.25.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.functions.timecols import seconds_between, whole_days_between

RISK_FREE = 0.015
SECONDS_PER_YEAR = 365.25 * 24 * 3600


def _equity_aggs(ts: str) -> list:
    return [F.count(F.lit(1)).alias("n_bars"),
            F.min(ts).alias("_t0"), F.max(ts).alias("_t1"),
            F.min_by("equity", "_ord").alias("_e0"), F.max_by("equity", "_ord").alias("final_equity"),
            F.avg("ret").alias("_mr"), F.stddev_samp("ret").alias("_sr"),
            F.min("drawdown").alias("_mdd")]


def _trade_aggs(pnl: str) -> list:
    p = F.col(pnl)
    return [F.count(p).alias("total_trades"),
            F.sum(F.when(p > 0, p)).alias("_gp"), F.sum(F.when(p < 0, p)).alias("_gl"),
            F.count(F.when(p > 0, 1)).alias("_nw"),
            F.avg(F.when(p > 0, p)).alias("_aw"), F.avg(F.when(p < 0, p)).alias("_al")]


def _equity_cols(risk_free: float) -> list:
    freq = F.when(F.col("n_bars") < 2, F.lit(245.0)).otherwise(
        F.try_divide(F.lit(SECONDS_PER_YEAR), seconds_between("_t0", "_t1") / (F.col("n_bars") - 1)))
    sharpe = (F.when(F.col("_sr").isNull(), F.lit(None).cast("double"))
              .when(F.col("_sr") == 0, F.lit(0.0))
              .otherwise((F.col("_mr") - F.lit(risk_free) / freq) / F.col("_sr") * F.sqrt(freq)))
    years = whole_days_between("_t0", "_t1") / F.lit(365.25)
    ratio = F.try_divide(F.col("final_equity"), F.col("_e0"))
    cagr = (F.when((F.col("n_bars") < 2) | (F.col("_e0") == 0), F.lit(0.0))
            .when(years <= 0, F.lit(0.0))
            .when(ratio < 0, F.lit(None).cast("double"))
            .otherwise(F.pow(ratio, F.lit(1.0) / years) - F.lit(1.0)))
    return [sharpe.alias("sharpe"),
            F.abs(F.coalesce(F.col("_mdd"), F.lit(0.0))).alias("max_drawdown"),
            cagr.alias("annual_return")]


def _trade_cols() -> list:
    n = F.coalesce(F.col("total_trades"), F.lit(0)).cast("long")
    return [profit_factor(F.col("_gp"), F.col("_gl")).alias("profit_factor"),
            F.coalesce(F.try_divide(F.col("_nw"), n), F.lit(0.0)).alias("win_rate"),
            n.alias("total_trades"),
            F.coalesce(F.col("_aw"), F.lit(0.0)).alias("avg_win"),
            F.coalesce(F.col("_al"), F.lit(0.0)).alias("avg_loss")]


def equity_stats(bt: DataFrame, keys: Sequence[str], ts: str = "ts",
                 risk_free: float = RISK_FREE) -> DataFrame:
    """Per key: sharpe, max_drawdown, annual_return, final_equity, n_bars."""
    g = bt.groupBy(*keys).agg(*_equity_aggs(ts))
    return g.select(*keys, "n_bars", *_equity_cols(risk_free), "final_equity")


def trade_stats(trades: DataFrame, keys: Sequence[str], pnl: str = "pnl") -> DataFrame:
    """Per key: profit_factor, win_rate, total_trades, avg_win, avg_loss."""
    g = trades.where(F.col(pnl).isNotNull()).groupBy(*keys).agg(*_trade_aggs(pnl))
    return g.select(*keys, *_trade_cols())


def profit_factor(gross_profit: Column, gross_loss: Column) -> Column:
    gp = F.coalesce(gross_profit, F.lit(0.0))
    gl = F.abs(F.coalesce(gross_loss, F.lit(0.0)))
    return (F.when(gl == 0, F.when(gp > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)))
            .otherwise(gp / gl))


def metrics_all(bt: DataFrame, keys: Sequence[str], ts: str = "ts", pnl: str = "trade_pnl",
                risk_free: float = RISK_FREE) -> DataFrame:
    """Equity and trade measures of a ledger in one aggregate pass (trade
    measures come from the closing bars' ``trade_pnl``)."""
    g = bt.groupBy(*keys).agg(*_equity_aggs(ts), *_trade_aggs(pnl))
    eq = _equity_cols(risk_free)
    trc = _trade_cols()
    return g.select(*keys, eq[0], eq[1], *trc[:2], trc[2], eq[2], *trc[3:],
                    "final_equity", "n_bars")


# Screening gates of the reference configuration (fixed values)
SCREEN_GATE = {"sharpe_min": 1.2, "max_drawdown_max": 0.35, "profit_factor_min": 1.0,
               "min_trades": 80}
# the gate of the admission rules
ADMISSION_GATE = {**SCREEN_GATE, "profit_factor_min": 1.3}
STRICT_GATE = {"sharpe_min": 1.5, "max_drawdown_max": 0.20, "profit_factor_min": 2.0,
               "min_trades": 100, "oos_is_ratio_min": 0.60}


def screen(metrics: DataFrame, gate: dict | None = None) -> DataFrame:
    """``passed`` and ``reasons`` (order: Sharpe, MaxDD, PF, trades).

    A NULL Sharpe fails no comparison (as NaN does in the reference)."""
    g = {**SCREEN_GATE, **(gate or {})}

    def fmt_num(v: float) -> str:
        return repr(float(v))

    r1 = F.when(F.coalesce(F.col("sharpe") < g["sharpe_min"], F.lit(False)),
                F.format_string(f"Sharpe %.2f < {fmt_num(g['sharpe_min'])}", F.col("sharpe")))
    r2 = F.when(F.col("max_drawdown") > g["max_drawdown_max"],
                F.format_string(f"MaxDD %.1f%% > {round(g['max_drawdown_max'] * 100)}%%",
                                F.col("max_drawdown") * 100))
    r3 = F.when(F.col("profit_factor") < g["profit_factor_min"],
                F.format_string(f"PF %.2f < {fmt_num(g['profit_factor_min'])}", F.col("profit_factor")))
    r4 = F.when(F.col("total_trades") < g["min_trades"],
                F.format_string(f"Trades %d < {int(g['min_trades'])}", F.col("total_trades")))
    reasons = F.filter(F.array(r1, r2, r3, r4), lambda x: x.isNotNull())
    return metrics.withColumns({"reasons": reasons, "passed": F.size(reasons) == 0})


def gate_two_stage(metrics: DataFrame, screen_gate: dict | None = None, strict_gate: dict | None = None,
                   ratio: str = "ratio") -> DataFrame:
    """``screen_passed`` (B9) and ``strict_passed``: those that passed the screening
    against the strict gate, whose own condition is the out-of-sample to in-sample
    ratio (without one it is not passed)."""
    strict = {**STRICT_GATE, **(strict_gate or {})}
    x = screen(metrics, screen_gate).withColumnRenamed("passed", "screen_passed").drop("reasons")
    x = screen(x, strict).drop("reasons")
    kept = F.coalesce(F.col(ratio) >= strict["oos_is_ratio_min"], F.lit(False))
    return x.withColumn("strict_passed", F.col("screen_passed") & F.col("passed") & kept).drop("passed")


# --------------------------------------------------------------------------
# equity reports
# --------------------------------------------------------------------------

def monthly_pnl(led: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Last equity of each calendar month minus the previous month's.

    Months are laid on a per-key month spine (calendar-bounded), so a month
    without bars is null and nulls its own and the next month's change; those
    and the first month are dropped.  ``month_end`` labels the row."""
    from barlake.operators.sequence import Window
    keys = list(keys)
    m = led.groupBy(*keys, F.trunc(F.to_date(ts), "month").alias("month")).agg(
        F.max_by("equity", ts).alias("eq"))
    span = m.groupBy(*keys).agg(F.min("month").alias("m0"), F.max("month").alias("m1"))
    spine = span.select(*keys, F.explode(F.sequence("m0", "m1", F.expr("INTERVAL 1 MONTH")))
                        .alias("month"))
    x = spine.join(m, [*keys, "month"], "left")
    w = Window.partitionBy(*keys).orderBy("month")
    x = x.withColumn("pnl", F.col("eq") - F.lag("eq", 1).over(w))
    return x.where(F.col("pnl").isNotNull()).select(
        *keys, F.last_day("month").alias("month_end"), F.year("month").alias("year"),
        F.month("month").alias("month"), "pnl")


def monthly_matrix(pnl: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Year × month pivot (m01..m12, missing months null) plus the yearly total."""
    keys = list(keys)
    cols = [F.sum(F.when(F.col("month") == i, F.col("pnl"))).alias(f"m{i:02d}") for i in range(1, 13)]
    return pnl.groupBy(*keys, "year").agg(*cols, F.sum("pnl").alias("total"))


def equity_daily(led: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Last equity per calendar date."""
    return led.groupBy(*keys, F.to_date(ts).alias("date")).agg(F.max_by("equity", ts).alias("equity"))


def signal_distribution(sig: DataFrame, keys: Sequence[str], signal: str = "signal") -> DataFrame:
    """Bars per signal value (long / short / flat) per key."""
    s = F.col(signal)
    return sig.groupBy(*keys).agg(F.count_if(s == 1).alias("n_long"), F.count_if(s == -1).alias("n_short"),
                                  F.count_if(s == 0).alias("n_flat"))


def trade_durations(led: DataFrame, keys: Sequence[str], ts: str = "ts", block=None) -> DataFrame:
    """Holding time of closed trades (entry bar → exit bar), mean minutes
    per key and the data range."""
    from barlake.operators.sequence import Last, scan
    x = scan(led, keys, {"_ets": (Last(), F.when(F.col("entry_price").isNotNull() & (
        F.col("position") != F.coalesce(F.col("position_prev"), F.lit(0))), F.col(ts)))},
        exclusive=["_ets"], block=block)
    closed = F.col("trade_pnl").isNotNull()
    mins = F.timestamp_diff("MINUTE", F.col("_ets_prev"), F.col(ts))
    return x.groupBy(*keys).agg(F.avg(F.when(closed, mins)).alias("avg_hold_minutes"),
                                F.count_if(closed).alias("n_closed"),
                                F.min(ts).alias("data_start"), F.max(ts).alias("data_end"))


# Upper bounds of the holding-time buckets in minutes: a day, a week, two, a month, a quarter
HOLDING_BUCKETS = [1440, 10_080, 20_160, 43_200, 129_600]
#: Items of a quantile sketch, and its error in rank (99 %).
SKETCH_K, SKETCH_ERROR = 200, 0.0133


def holding_times(led: DataFrame, keys: Sequence[str], ts: str = "ts", block=None) -> DataFrame:
    """Closed trades of a ledger with the minutes between entry and exit bar."""
    from barlake.operators.sequence import Last, scan
    entered = F.col("entry_price").isNotNull() & (F.col("position") != F.coalesce(F.col("position_prev"), F.lit(0)))
    x = scan(led, keys, {"_ets": (Last(), F.when(entered, F.col(ts)))}, exclusive=["_ets"], block=block)
    return x.where(F.col("trade_pnl").isNotNull()).select(
        *keys, F.col(ts).alias("exit_ts"), F.timestamp_diff("MINUTE", F.col("_ets_prev"), F.col(ts)).alias("minutes"))


def holding_time_buckets(held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trades per key and holding-time bucket (``bucket`` is the lower bound in minutes)."""
    low = F.lit(0)
    for bound in HOLDING_BUCKETS:
        low = F.when(F.col("minutes") >= bound, F.lit(bound)).otherwise(low)
    return held.groupBy(*keys, low.cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n_trades"))


def holding_time_quantiles(held: DataFrame, keys: Sequence[str], quantiles: Sequence[float], k: int = SKETCH_K) -> DataFrame:
    """Quantiles per key from a KLL sketch: a few hundred items per key and task
    that merge, whatever the number of trades."""
    sketch = held.groupBy(*keys).agg(F.kll_sketch_agg_bigint("minutes", k).alias("_s"))
    return sketch.select(*keys, F.explode(F.array(*[F.struct(
        F.lit(q).alias("quantile"), F.kll_sketch_get_quantile_bigint("_s", F.lit(q)).alias("value")) for q in quantiles])).alias("q")) \
        .select(*keys, "q.quantile", "q.value")


# Health alert levels (losing streak, drawdown share of the limit)
HEALTH_LEVELS = [("red", 10, 0.80), ("orange", 8, 0.70), ("yellow", 5, 0.50)]


def loss_streaks(trades: DataFrame, keys: Sequence[str], pnl: str = "pnl", block=None) -> DataFrame:
    """Running count of consecutive losing trades (pnl < 0), reset by any
    other trade; ``trades`` must carry ``_ord``."""
    from barlake.operators.sequence import Last, Sum, scan
    loss = (F.col(pnl) < 0).cast("long")
    x = scan(trades, keys, {"_cl": (Sum(), loss)}, block=block)
    x = scan(x, keys, {"_base": (Last(), F.when(F.col(pnl) >= 0, F.col("_cl")))}, block=block)
    return x.withColumn("loss_streak", F.col("_cl") - F.coalesce(F.col("_base"), F.lit(0))) \
            .drop("_cl", "_base")


def health_level(streak: Column, dd_ratio: Column) -> Column:
    """Worst level reached by the streak or drawdown/limit rule."""
    e = None
    for name, n, r in HEALTH_LEVELS:
        cond = (streak >= n) | (dd_ratio >= r)
        e = F.when(cond, F.lit(name)) if e is None else e.when(cond, F.lit(name))
    return e.otherwise(F.lit("green"))
