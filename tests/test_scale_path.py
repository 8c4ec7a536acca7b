"""The blocked (multi-level) path must give the same answers as the one-block
path on the driver's data: small blocks force halos, carries and checkpoints."""
from pyspark.sql import functions as F

from barlake.operators import indicators as ind
from barlake.operators import signals as sg
from barlake.operators.sequence import sequence
from barlake.plans import backtests
from barlake.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def _rows(df, cols):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def test_backtest_metrics_blocked(spark):
    a = backtests.ma_cross_backtest_metrics(spark, SF)
    b = backtests.ma_cross_backtest_metrics(spark, SF, block=32)
    cols = a.columns
    assert _rows(a, cols) == _rows(b, cols)


def test_indicators_blocked(spark):
    bars = fx.day_bars(spark, SF)
    specs = [("ema", "e12", "close", 12), ("rsi", "rsi", 14, "ratio"), ("atr", "atr", 14), ("adx", "", 14),
             ("macd", "", 12, 26, 9)]
    outs = []
    for block in (None, 16):
        kw = {"block": block} if block else {}
        b, bl = sequence(bars, ["symbol"], ["ts"], bucket=F.date_trunc("month", "ts"), **kw)
        d = ind.compute(b, ["symbol"], specs, block=bl)
        d = sg.rsi_reversal(d.drop("rsi"), ["symbol"], block=bl)
        outs.append(_rows(d, ["symbol", "ts", "e12", "atr", "adx", "dmp", "macd", "macd_signal", "signal"]))
    assert outs[0] == outs[1]
