import datetime as dt

from pyspark.sql import functions as F

from barlake.operators import retrieval as rv
from barlake.operators import signals as sg


def test_category_filters(spark):
    df = spark.createDataFrame([(["swing_day", "trend", "daytrade_night", "breakout", "13:35"],)],
                               "e array<string>")
    r = df.select(*[v.alias(k) for k, v in rv.category_filters(F.col("e")).items()]).first()
    assert r.session_filter == "daytrade_night" and r.logic_filter == "breakout"


def test_keyword_hit_parity(spark):
    df = spark.createDataFrame([(["Trend", "swing_day"], "a swing_day trend idea", "xx")], "e array<string>, t string, q string")
    r = df.select(rv.keyword_hit(F.col("e"), F.col("t"), F.col("q")).alias("p"),
                  rv.keyword_hit(F.col("e"), F.lit("none"), F.col("q"), case_insensitive=True).alias("c")).first()
    assert r.p is True and r.c is False


def test_pandas_strategy_per_day(spark):
    rows = [("S", dt.datetime(2020, 1, d, 9, m), float(100 + m)) for d in (1, 2) for m in range(5)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double")
    spec = sg.register_pandas_strategy("test_up", lambda pdf: (pdf["close"].diff() > 0).astype(int), {})
    out = spec.fn(df, ["symbol"]).orderBy("ts").collect()
    assert [r.signal for r in out] == [0, 0, 1, 1, 1] * 2
    sg.REGISTRY.pop("test_up")


def test_stop_limits(spark):
    df = spark.createDataFrame([(120.0, "daytrade"), (200.0, "daytrade"), (200.0, "swing")], "p double, h string")
    assert [r[0] for r in df.select(rv.stop_limit_ok(F.col("p"), F.col("h"))).collect()] == [True, False, True]
