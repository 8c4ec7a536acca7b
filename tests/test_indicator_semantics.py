"""Indicators against straightforward pandas computations of the same
definitions (seeded EMA on ewm(adjust=False), Wilder means as
ewm(alpha=1/n, min_periods=n), true range, directional movement)."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barlake.operators import indicators as ind
from barlake.operators.sequence import sequence


def _series(n=240, seed=4):
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0, 1, n))
    high = close + rng.uniform(0, 1.5, n)
    low = close - rng.uniform(0, 1.5, n)
    return pd.DataFrame({"close": close, "high": high, "low": low})


def _ema_ref(x: pd.Series, n: int) -> pd.Series:
    x = x.copy()
    seed = x.iloc[:n].mean()
    x.iloc[:n - 1] = np.nan
    x.iloc[n - 1] = seed
    return x.ewm(span=n, adjust=False).mean()


def _rma(x: pd.Series, n: int) -> pd.Series:
    return x.ewm(alpha=1.0 / n, min_periods=n).mean()


def test_against_pandas(spark):
    p = _series()
    rows = [("S", i, float(c), float(h), float(l)) for i, (c, h, l) in enumerate(zip(p.close, p.high, p.low))]
    df = spark.createDataFrame(rows, "symbol string, t long, close double, high double, low double")
    b, bl = sequence(df, ["symbol"], ["t"], bucket=F.floor(F.col("t") / 50))
    got = ind.compute(b, ["symbol"], [("ema", "e12", "close", 12), ("rsi", "rsi", 14, "ratio"),
                                      ("rsi", "rsis", 14, "share"), ("atr", "atr", 14), ("adx", "", 14),
                                      ("macd", "", 12, 26, 9)], block=bl).toPandas().sort_values("t")
    # references
    e12 = _ema_ref(p.close, 12)
    d = p.close.diff()
    g, lo = _rma(d.clip(lower=0), 14), _rma((-d).clip(lower=0), 14)
    rsi = 100 - 100 / (1 + g / lo.replace(0, np.nan))
    rsis = 100 * g / (g + lo)
    pc = p.close.shift(1)
    tr = pd.concat([p.high - p.low, (p.high - pc).abs(), (pc - p.low).abs()], axis=1).max(axis=1)
    tr.iloc[0] = np.nan
    atr = _rma(tr, 14)
    up, dn = p.high.diff(), -p.low.diff()
    pos = ((up > dn) & (up > 0)) * up
    neg = ((dn > up) & (dn > 0)) * dn
    pos.iloc[0] = neg.iloc[0] = np.nan
    dmp, dmn = 100 / atr * _rma(pos, 14), 100 / atr * _rma(neg, 14)
    adx = _rma(100 * (dmp - dmn).abs() / (dmp + dmn), 14)
    macd = _ema_ref(p.close, 12) - _ema_ref(p.close, 26)
    first = macd.first_valid_index()
    sig = pd.Series(np.nan, index=macd.index)
    sig.loc[first:] = _ema_ref(macd.loc[first:].reset_index(drop=True), 9).to_numpy()
    for col, ref in [("e12", e12), ("rsi", rsi), ("rsis", rsis), ("atr", atr), ("adx", adx), ("dmp", dmp),
                     ("macd", macd), ("macd_signal", sig)]:
        a = got[col].astype(float).to_numpy()
        r = ref.astype(float).to_numpy()
        assert np.array_equal(np.isnan(a), np.isnan(r)), col
        assert np.nanmax(np.abs(a - r)) < 1e-8, col
