"""Named plans: indicators (F1–F11) and signal generators (G1–G11) on daily bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.operators import indicators as ind
from barlake.operators import signals as sg
from barlake.operators.sequence import rolling
from barlake.plans.backtests import KEYS, day_bar_seq
from barlake.plans.common import round_doubles


def _r(df: DataFrame, cols: list[str], digits: int) -> DataFrame:
    return df.select("symbol", "ts", *[F.round(c, digits).alias(c) for c in cols])


def ema_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, bl = day_bar_seq(spark, sf_dir)
    return _r(ind.compute(b, KEYS, [("ema", "ema_12", "close", 12)], block=bl), ["ema_12"], 4)


def macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, bl = day_bar_seq(spark, sf_dir)
    return _r(ind.compute(b, KEYS, [("macd", "", 12, 26, 9)], block=bl), ["macd", "macd_signal", "macd_hist"], 4)


def rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, bl = day_bar_seq(spark, sf_dir)
    d = ind.compute(b, KEYS, [("rsi", "rsi", 14, "ratio"), ("rsi", "rsi_wilder", 14, "share")], block=bl)
    return _r(d, ["rsi", "rsi_wilder"], 6)


def atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, bl = day_bar_seq(spark, sf_dir)
    return _r(ind.compute(b, KEYS, [("atr", "atr", 14)], block=bl), ["atr"], 4)


def adx(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, bl = day_bar_seq(spark, sf_dir)
    return _r(ind.compute(b, KEYS, [("adx", "", 14)], block=bl), ["adx", "dmp", "dmn"], 6)


def bollinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, bl = day_bar_seq(spark, sf_dir)
    d = ind.bollinger(b, KEYS, "close", 20, 2.0, block=bl)
    d = rolling(d, KEYS, lambda w: {"highest_20": ind.w_max("high", 20, w),
                                    "lowest_20": ind.w_min("low", 20, w)}, 19, block=bl)
    return _r(d, ["bb_mid", "bb_upper", "bb_lower", "highest_20", "lowest_20"], 4)


def signals(fn, **params):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        b, bl = day_bar_seq(spark, sf_dir)
        return fn(b, KEYS, block=bl, **params).select("symbol", "ts", "signal")
    q.__name__ = f"signals_{fn.__name__}"
    return q


SIGNAL_FNS = {
    "ma_cross": sg.ma_cross, "rsi_reversal": sg.rsi_reversal, "dual_ema_cross": sg.dual_ema_cross,
    "dual_ema_atr_trend": sg.dual_ema_atr_trend, "ema_adx": sg.ema_adx,
    "macd_ma_trend": sg.macd_ma_trend, "macd_rsi_trend": sg.macd_rsi_trend,
    "macd_trend_confirm": sg.macd_trend_confirm, "trend_breakout": sg.trend_breakout,
    "trend_catcher": sg.trend_catcher, "trend_filtered_ema": sg.trend_filtered_ema,
}


# indicator needs of the registered strategies at their default parameters
ALL_SPECS = [("ema", "x", "close", n) for n in (9, 12, 18, 20, 21, 26, 50, 55)] + [
    ("rsi", "x", 14, "ratio"), ("rsi", "x", 14, "share"), ("atr", "x", 14), ("adx", "", 14),
    ("macd", "", 12, 26, 9)]


def strategy_backtests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6 screening run: every registered strategy × symbol in one job.  The
    strategies' signals are stacked as rows keyed by (strategy, symbol), so
    one ledger and one metrics pass serve all of them (rows-only check)."""
    from barlake.plans.backtests import backtest_report
    from barlake.session import materialize
    b, bl = day_bar_seq(spark, sf_dir)
    base = b.select("symbol", "ts", "_ord", "open", "high", "low", "close")
    # every indicator any registered strategy needs, in one fused pass, written
    # once; the generators then alias these columns instead of recomputing
    base = materialize(ind.precompute(base, KEYS, ALL_SPECS, block=bl))
    sigs = None
    for name, spec in sg.REGISTRY.items():
        s = spec.fn(base, KEYS, block=bl, **spec.defaults).select(
            F.lit(name).alias("strategy"), "symbol", "ts", "_ord", "close", "signal")
        sigs = s if sigs is None else sigs.unionByName(s)
    res = backtest_report(sigs, keys=["strategy", "symbol"], block=bl)
    return round_doubles(res.withColumn("status", F.when(F.col("passed"), "reviewing").otherwise("draft")))
