"""Named back-test plans: bars → signals → ledger → metrics → gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.operators import backtest as bt
from barlake.operators import metrics as mt
from barlake.operators import signals as sg
from barlake.operators.sequence import sequence
from barlake.plans.common import round_doubles
from barlake.sources import fixtures as fx

KEYS = ["symbol"]


def day_bar_seq(spark: SparkSession, sf_dir: str, block=None):
    """Daily bars numbered per symbol (numbering groups: symbol × month)."""
    return sequence(fx.day_bars(spark, sf_dir), KEYS, ["ts"],
                    bucket=F.date_trunc("month", F.col("ts")), **({"block": block} if block else {}))


def backtest_report(bars_sig: DataFrame, keys=KEYS, contract=bt.Contract(), gate=None,
                    block=None) -> DataFrame:
    led = bt.backtest(bars_sig, keys, contract, block=block)
    m = mt.metrics_all(led, keys)
    s = mt.screen(m, gate)
    return s.withColumn("reasons", F.array_join("reasons", "; "))


def ma_cross_backtest_metrics(spark: SparkSession, sf_dir: str, block=None) -> DataFrame:
    """Slice 1: G1(20, 60) on daily bars, H1–H3 ledger, D8 metrics, B9 gate."""
    bars, bl = day_bar_seq(spark, sf_dir, block)
    sig = sg.ma_cross(bars, KEYS, 20, 60, block=bl)
    return round_doubles(backtest_report(sig, block=bl))
