"""Breakout entries (G12, E18) on hand-made orders: the next bar fills or not, one entry a day."""
import datetime as dt

from barlake.operators import intraday as it


def test_first_filled_order_of_the_day(spark, monkeypatch):
    base = dt.datetime(2020, 1, 2, 9, 0)
    rows = []
    # (open, high, low, close, side, stop): the stop acts on the next bar
    bars = [(100, 101, 99, 100, 1, 120.0), (104, 106, 103, 105, 1, 107.0), (110, 111, 104, 105, -1, 50.0),
            (50, 51, 40, 50, 1, 60.0)]
    for i, (o, h, l, c, side, stop) in enumerate(bars):
        rows.append(("S", base + dt.timedelta(minutes=5 * i), float(o), float(h), float(l), float(c), base.date(), side, 1, stop, i + 1))
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, "
                               "trading_day date, order_side int, order_qty int, order_stop double, k int")
    monkeypatch.setattr(it, "prior_day_features", lambda b, keys, day: b)
    monkeypatch.setattr(it, "intraday_counters", lambda b, keys, day, block=None: b)
    monkeypatch.setattr(it, "breakout_orders", lambda b, l, s: b)
    got = it.breakout_entries(df).collect()
    # bar 1's stop of 120 is not reached; bar 2's of 107 fills at the worse open 110
    assert [(r.side, r.entry_price, r.entry_ts) for r in got] == [(1, 110.0, base + dt.timedelta(minutes=10))]
