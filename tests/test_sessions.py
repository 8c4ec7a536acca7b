"""Reference trading-day and session cases, reproduced as literal rows."""
import datetime as dt

from pyspark.sql import functions as F

from barlake.operators import sessions as ss


def _ts(s):
    return dt.datetime.strptime(s, "%Y-%m-%d %H:%M")


def _assign(spark, stamps, on_tail="batch"):
    df = spark.createDataFrame([("TX", _ts(s)) for s in stamps], "symbol string, ts timestamp_ntz")
    out = ss.assign_trading_day(df, ["symbol"], on_tail=on_tail)
    return {r.ts.strftime("%Y-%m-%d %H:%M"): r.trading_day for r in out.collect()}


def test_pre_holiday_friday_night(spark):
    got = _assign(spark, ["2015-02-13 15:00", "2015-02-13 22:00", "2015-02-16 08:45", "2015-02-16 08:46"])
    assert got["2015-02-13 15:00"] == dt.date(2015, 2, 16)
    assert got["2015-02-13 22:00"] == dt.date(2015, 2, 16)
    assert got["2015-02-16 08:46"] == dt.date(2015, 2, 16)


def test_weekend_night_and_closed_day(spark):
    got = _assign(spark, ["2015-01-09 15:00", "2015-01-10 01:00", "2015-01-12 08:45"])
    assert got["2015-01-09 15:00"] == dt.date(2015, 1, 12)
    assert got["2015-01-10 01:00"] == dt.date(2015, 1, 12)
    got = _assign(spark, ["2015-08-07 01:00", "2015-08-10 08:45"])
    assert got["2015-08-07 01:00"] == dt.date(2015, 8, 10)


def test_ordinary_day(spark):
    got = _assign(spark, ["2015-01-05 15:00", "2015-01-06 01:00", "2015-01-06 08:45"])
    assert got["2015-01-05 15:00"] == dt.date(2015, 1, 6)
    assert got["2015-01-06 01:00"] == dt.date(2015, 1, 6)


def test_tail_modes(spark):
    stamps = ["2015-01-05 08:45", "2015-01-05 15:00", "2015-01-06 01:00"]
    got = _assign(spark, stamps, "batch")
    assert got["2015-01-05 15:00"] is None
    assert got["2015-01-06 01:00"] == dt.date(2015, 1, 6)
    got = _assign(spark, stamps, "null")
    assert got["2015-01-06 01:00"] is None


def test_session_classes(spark):
    cases = {"08:45": "day_session", "12:30": "day_session", "13:45": "day_session",
             "15:00": "night_session", "22:00": "night_session", "02:00": "night_session",
             "05:00": "night_session", "13:46": "non_trading", "14:00": "non_trading",
             "06:00": "non_trading", "08:00": "non_trading"}
    df = spark.createDataFrame([(k, _ts("2015-01-05 " + k)) for k in cases], "k string, ts timestamp_ntz")
    out = df.select("k", ss.classify_session("ts").alias("s"), ss.is_day("ts", False).alias("hd"),
                    ss.is_night("ts", False).alias("hn")).collect()
    for r in out:
        assert r.s == cases[r.k], r.k
    half = {r.k: (r.hd, r.hn) for r in out}
    assert half["13:45"] == (False, False)   # half-open slices exclude the ends
    assert half["05:00"] == (False, False)


def test_fractional_second_outside_day(spark):
    df = spark.createDataFrame([(dt.datetime(2015, 1, 5, 13, 45, 0, 500000),)], "ts timestamp_ntz")
    assert df.select(ss.classify_session("ts")).first()[0] == "non_trading"


def test_can_open_and_force_close(spark):
    rows = [("daytrade_day", "13:24", True, False), ("daytrade_day", "13:25", False, False),
            ("daytrade_day", "13:39", False, True), ("daytrade_night", "04:24", True, False),
            ("daytrade_night", "04:44", False, True), ("swing_day", "13:45", True, False),
            ("swing_full", "14:00", False, False), ("swing_full", "03:00", True, False)]
    df = spark.createDataFrame([(c, _ts("2015-01-05 " + t), o, f) for c, t, o, f in rows],
                               "c string, ts timestamp_ntz, o boolean, f boolean")
    out = df.select((ss.can_open("ts", F.col("c")) == F.col("o")).alias("a"),
                    (ss.must_force_close("ts", F.col("c")) == F.col("f")).alias("b")).collect()
    assert all(r.a and r.b for r in out)
