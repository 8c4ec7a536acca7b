"""The blocked sequence kernel must not depend on the block size."""
import pandas as pd
from pyspark.sql import functions as F

from barlake.operators import sequence as sq


def _frame(spark, n=60, keys=3):
    rows = []
    for k in range(keys):
        for i in range(n + 7 * k):
            x = ((i * 37 + k * 11) % 23) - 11.0
            rows.append((f"k{k}", i * 10 + k, x, None if i % 9 == 4 else x))
    return spark.createDataFrame(rows, "key string, t long, x double, y double")


def _run(spark, block, max_len=None):
    df = _frame(spark)
    bl = sq.Blocking(block, 3, max_len) if max_len is None else sq.plan_blocking(max_len, block)
    d, _ = sq.sequence(df, ["key"], ["t"], bucket=F.floor(F.col("t") / 50), block=block,
                       max_len=max_len)
    if max_len is None:
        d = sq.with_ordinal(df, ["key"], ["t"], bucket=F.floor(F.col("t") / 50))
    d = sq.rolling(d, ["key"], lambda w: {"lag2": F.lag("x", 2).over(w),
                                         "lead1": F.lead("x", 1).over(w),
                                         "m3": F.avg("x").over(w.rowsBetween(-2, 0))},
                   2, 1, block=bl)
    d = sq.scan(d, ["key"], {"cs": (sq.Sum(), F.col("x")), "mx": (sq.Max(), F.col("x")),
                             "ff": (sq.Last(), F.col("y")),
                             "ema": (sq.Affine(), {"a": F.lit(0.8), "b": F.lit(0.2) * F.col("x")})},
                exclusive=["cs", "ff", "ema"], block=bl, checkpoint=False)
    return d.toPandas().sort_values(["key", "t"]).reset_index(drop=True)


def _expected(spark):
    p = _frame(spark).toPandas().sort_values(["key", "t"])
    out = []
    for _, g in p.groupby("key"):
        g = g.copy()
        g["_ord"] = range(len(g))
        g["lag2"] = g.x.shift(2)
        g["lead1"] = g.x.shift(-1)
        g["m3"] = g.x.rolling(3, min_periods=1).mean()
        g["cs"] = g.x.cumsum()
        g["cs_prev"] = g.cs.shift(1)
        g["mx"] = g.x.cummax()
        g["ff"] = g.y.ffill()
        g["ff_prev"] = g.ff.shift(1)
        e, prev, es = 0.0, [], []
        for v in g.x:
            prev.append(e if es else None)
            e = 0.8 * e + 0.2 * v
            es.append(e)
        g["ema_b"] = es
        g["ema_b_prev"] = prev
        out.append(g)
    return pd.concat(out).reset_index(drop=True)


def test_block_invariance(spark):
    exp = _expected(spark)
    for block, max_len in [(4, None), (7, None), (64, 80), (5, 80)]:
        got = _run(spark, block, max_len)
        assert list(got._ord) == list(exp._ord)
        for c in ["lag2", "lead1", "m3", "cs", "cs_prev", "mx", "ff", "ff_prev", "ema_b",
                  "ema_b_prev"]:
            a = got[c].astype(float).fillna(-999).round(9).tolist()
            b = exp[c].astype(float).fillna(-999).round(9).tolist()
            assert a == b, (block, c)


def test_guard_raises_when_too_long(spark):
    import pytest
    df = _frame(spark)
    d = sq.with_ordinal(df, ["key"], ["t"])
    out = sq.scan(d, ["key"], {"cs": (sq.Sum(), F.col("x"))}, block=sq.Blocking(4, 1, None),
                  checkpoint=False)
    with pytest.raises(Exception):
        out.collect()
