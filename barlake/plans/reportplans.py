"""Named plans: equity reports, trade statistics and health alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.operators import backtest as bt
from barlake.operators import metrics as mt
from barlake.operators import signals as sg
from barlake.operators.sequence import Max, Sum, scan, sequence
from barlake.plans.backtests import KEYS, day_bar_seq
from barlake.plans.common import round_doubles
from barlake.sources import fixtures as fx


def _ledger(spark, sf_dir):
    b, bl = day_bar_seq(spark, sf_dir)
    return bt.backtest(sg.ma_cross(b, KEYS, 20, 60, block=bl), KEYS, block=bl), bl


def monthly_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    led, _ = _ledger(spark, sf_dir)
    return round_doubles(mt.monthly_pnl(led, KEYS), 2)


def monthly_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    led, _ = _ledger(spark, sf_dir)
    return round_doubles(mt.monthly_matrix(mt.monthly_pnl(led, KEYS), KEYS), 2)


def drawdown_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equity, running peak and underwater share per bar."""
    led, _ = _ledger(spark, sf_dir)
    return round_doubles(led.select("symbol", "ts", F.round("equity", 2).alias("equity"),
                                    F.round("peak", 2).alias("peak"), "drawdown"), 6)


def equity_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    led, _ = _ledger(spark, sf_dir)
    return round_doubles(mt.equity_daily(led, KEYS), 2)


def signal_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, bl = day_bar_seq(spark, sf_dir)
    return mt.signal_distribution(sg.ma_cross(b, KEYS, 20, 60, block=bl), KEYS)


def trade_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2 + H4: closed trades of the SMA-cross ledger, with the flat-slippage PnL
    of the current rules beside the ledger PnL."""
    led, _ = _ledger(spark, sf_dir)
    t = bt.trades(led, KEYS).drop("_ord")
    t = t.withColumn("pnl_flat", bt.flat_slippage_pnl(F.col("entry_price"), F.col("exit_price"), F.col("side")))
    return round_doubles(t, 2)


def trade_list_open(spark: SparkSession, sf_dir: str, block=None) -> DataFrame:
    """H2 with ``fill='open'``: closed trades of the SMA cross, settled at opens."""
    b, bl = day_bar_seq(spark, sf_dir, block)
    led = bt.backtest_open(sg.ma_cross(b, KEYS, 20, 60, block=bl), KEYS, block=bl)
    return round_doubles(bt.open_trades(led, KEYS).drop("forced"), 2)


def trade_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    led, bl = _ledger(spark, sf_dir)
    return round_doubles(mt.trade_durations(led, KEYS, block=bl), 4)


def holding_time_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades of the SMA cross by holding time."""
    led, bl = _ledger(spark, sf_dir)
    return mt.holding_time_buckets(mt.holding_times(led, KEYS, block=bl), KEYS)


QUANTILES = [0.1, 0.25, 0.5, 0.75, 0.9]


def holding_time_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the holding time from a mergeable sketch, held against the exact
    ranks: is the rank of each within the sketch's error?"""
    led, bl = _ledger(spark, sf_dir)
    held = mt.holding_times(led, KEYS, block=bl)
    q = mt.holding_time_quantiles(held, KEYS, QUANTILES)
    n = held.join(q, KEYS).groupBy(*KEYS, "quantile").agg(
        F.avg((F.col("minutes") < F.col("value")).cast("double")).alias("below"),
        F.avg((F.col("minutes") <= F.col("value")).cast("double")).alias("upto"))
    ok = (F.col("below") <= F.col("quantile") + mt.SKETCH_ERROR) & (F.col("upto") >= F.col("quantile") - mt.SKETCH_ERROR)
    return n.select(*KEYS, "quantile", ok.alias("rank_within_error"))


TKEYS = ["strategy"]


def _trades_seq(spark, sf_dir, block=None):
    t = fx.trades_fx(spark, sf_dir)
    return sequence(t, TKEYS, ["exit_ts", "orderkey", "linenumber"], ranged=True, **({"block": block} if block else {}))


def loss_streaks(spark: SparkSession, sf_dir: str, block=None) -> DataFrame:
    t, bl = _trades_seq(spark, sf_dir, block)
    out = mt.loss_streaks(t, TKEYS, block=bl)
    return round_doubles(out.select("strategy", "exit_ts", "orderkey", "linenumber", "pnl",
                                    "loss_streak"), 4)


def health_alerts(spark: SparkSession, sf_dir: str, capital: float = 500_000.0,
                  dd_limit: float = 0.20) -> DataFrame:
    """Per strategy the latest streak, drawdown against the limit, the
    alert level now and the worst level reached."""
    t, bl = _trades_seq(spark, sf_dir)
    x = mt.loss_streaks(t, TKEYS, block=bl)
    x = scan(x, TKEYS, {"_cum": (Sum(), F.col("pnl"))}, block=bl)
    x = x.withColumn("equity", F.lit(capital) + F.col("_cum"))
    x = scan(x, TKEYS, {"peak": (Max(), F.col("equity"))}, block=bl)
    x = x.withColumn("dd_ratio", F.try_divide(F.col("peak") - F.col("equity"), F.col("peak"))
                     / F.lit(dd_limit))
    x = x.withColumn("level", mt.health_level(F.col("loss_streak"), F.col("dd_ratio")))
    rank = (F.when(F.col("level") == "red", 3).when(F.col("level") == "orange", 2)
            .when(F.col("level") == "yellow", 1).otherwise(0))
    g = x.groupBy(*TKEYS).agg(
        F.max_by(F.struct("loss_streak", "dd_ratio", "level"), "_ord").alias("last"),
        F.max(rank).alias("_worst"), F.max("loss_streak").alias("max_loss_streak"),
        F.count(F.lit(1)).alias("n_trades"))
    worst = (F.when(F.col("_worst") == 3, "red").when(F.col("_worst") == 2, "orange")
             .when(F.col("_worst") == 1, "yellow").otherwise("green"))
    return round_doubles(g.select(*TKEYS, "n_trades", F.col("last.loss_streak").alias("loss_streak"),
                                  F.col("last.dd_ratio").alias("dd_ratio"),
                                  F.col("last.level").alias("level"), worst.alias("worst_level"),
                                  "max_loss_streak"), 6)
