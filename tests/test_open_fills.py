"""Orders settled at opens, forced exits and the flat times of the day-trading classes."""
import datetime as dt

from pyspark.sql import functions as F

from barlake.operators import backtest as bt
from barlake.operators import sessions as ss
from barlake.operators.sequence import Blocking, sequence
from barlake.plans import intradayplans as ip
from barlake.plans import reportplans as rp

SF = "/root/testdata/sf0.001"


def _bars(spark, rows):
    start = dt.datetime(2020, 1, 1)
    data = [("S", start + dt.timedelta(days=i), float(o), float(c), s, x) for i, (o, c, s, x) in enumerate(rows)]
    df = spark.createDataFrame(data, "symbol string, ts timestamp_ntz, open double, close double, signal int, mark boolean")
    return sequence(df, ["symbol"], ["ts"])


def test_reversal_and_forced_exit_by_hand(spark):
    df, bl = _bars(spark, [(100, 101, 0, False), (102, 104, 1, False), (103, 105, 0, False), (106, 104, -1, False),
                           (101, 100, 0, True), (99, 98, 1, False), (97, 96, 0, False), (95, 97, 1, True)])
    led = bt.backtest_open(df, ["symbol"], exit_marker="mark", block=bl).orderBy("ts").collect()
    # the long of bar 1 reverses at bar 3's open; the mark of bar 4 closes at bar 5's open and
    # swallows that bar's signal; the mark of the last bar is never settled
    assert [r.position for r in led] == [0, 1, 1, -1, -1, 0, 0, 1]
    assert [r.trade_pnl for r in led] == [None, None, None, 4 * 200 - 600, None, 7 * 200 - 600, None, None]
    assert [r.forced for r in led] == [False] * 5 + [True, False, False]
    # entries cost 300, closes 600; each bar earns the old position up to its open, then the new one
    want = [500000, 500000 + 2 * 200 - 300]
    want.append(want[-1] + 200)
    want.append(want[-1] + 200 * (1 + 2) - 900)
    want.append(want[-1] + 200 * 4)
    want.append(want[-1] + 200 - 600)
    want.append(want[-1])
    want.append(want[-1] + 400 - 300)
    assert [round(r.equity, 6) for r in led] == want
    small = bt.backtest_open(df, ["symbol"], exit_marker="mark", block=Blocking(2, 4, None)).orderBy("ts").collect()
    assert [(r.position, r.trade_pnl, round(r.equity, 6), r.forced) for r in small] == \
        [(r.position, r.trade_pnl, round(r.equity, 6), r.forced) for r in led]


def test_force_exit_with_holes(spark):
    def t(s):
        return dt.datetime.fromisoformat(s)
    rows = [("2020-01-02 13:30:00", False), ("2020-01-02 13:39:00", True), ("2020-01-02 13:40:00", False),
            ("2020-01-03 09:00:00", False), ("2020-01-03 13:20:00", True), ("2020-01-06 13:41:00", False)]
    df = spark.createDataFrame([("S", t(a), b) for a, b in rows], "symbol string, ts timestamp_ntz, want boolean")
    x, bl = sequence(df, ["symbol"], ["ts"])
    assert all(r.exit_marker == r.want for r in ss.force_exit(x, ["symbol"], "daytrade_day", block=bl).collect())
    night = [("2020-01-02 15:00:00", False), ("2020-01-02 23:50:00", False), ("2020-01-03 04:44:00", True),
             ("2020-01-03 04:45:00", False), ("2020-01-03 16:00:00", True), ("2020-01-06 15:00:00", True)]
    df = spark.createDataFrame([("S", t(a), b) for a, b in night], "symbol string, ts timestamp_ntz, want boolean")
    x, bl = sequence(df, ["symbol"], ["ts"])
    assert all(r.exit_marker == r.want for r in ss.force_exit(x, ["symbol"], "daytrade_night", block=bl).collect())


def test_blocked_path_equals_one_block(spark):
    for fn in (rp.trade_list_open, ip.session_trades):
        a = sorted(map(tuple, fn(spark, SF).collect()))
        assert a and a == sorted(map(tuple, fn(spark, SF, block=64).collect()))


def test_nothing_is_held_past_the_flat_time(spark):
    out = ip.session_backtest(spark, "/root/testdata/sf0.01")
    assert out.filter(F.col("n_forced") > 0).count() > 0
    assert out.agg(F.sum("n_held_past_flat")).first()[0] == 0
