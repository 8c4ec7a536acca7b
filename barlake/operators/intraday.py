"""Intraday features and the entries of the prior-range breakout strategy (C7,
E6, E7, E18, F12, G12).

Daily aggregates per (symbol, trading day) are lagged over the day table and
joined back to the bars; per-day counters and the one entry a day are windows
inside one trading day (a day holds a bounded number of bars).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.timecols import seconds_of_day
from barlake.operators.sequence import rolling


def daily_table(bars: DataFrame, keys: Sequence[str], day: str = "trading_day") -> DataFrame:
    """Open/high/low/close per (key, trading day)."""
    return bars.groupBy(*keys, day).agg(F.min_by("open", "ts").alias("opend"), F.max("high").alias("highd"),
                                        F.min("low").alias("lowd"), F.max_by("close", "ts").alias("closed"))


def prior_day_features(bars: DataFrame, keys: Sequence[str], day: str = "trading_day") -> DataFrame:
    """C7 + F12: previous closes 1–3, highs/lows 1–2, open 2 days back, and the
    range features (distance, HHLL, dis, condition30) joined to every bar."""
    keys = list(keys)
    d = daily_table(bars, keys, day)
    w = Window.partitionBy(*keys).orderBy(day)      # one row per key and calendar day
    lags = {"closed1": ("closed", 1), "closed2": ("closed", 2), "closed3": ("closed", 3), "highd1": ("highd", 1),
            "highd2": ("highd", 2), "lowd1": ("lowd", 1), "lowd2": ("lowd", 2), "opend2": ("opend", 2)}
    d = d.withColumns({out: F.lag(c, n).over(w) for out, (c, n) in lags.items()})
    c1, c2, c3 = F.col("closed1"), F.col("closed2"), F.col("closed3")
    hd, ld = F.greatest(c1, c2, c3), F.least(c1, c2, c3)
    d = d.withColumns({
        "dcavg3": (c1 + c2 + c3) / 3,
        "distance": F.greatest(F.lit(25.0), F.abs(hd - ld)),
        "hhll": F.greatest(F.lit(50.0), F.greatest("highd1", "highd2") - F.least("lowd1", "lowd2")),
        "dis": F.greatest(F.lit(25.0), F.abs(F.col("opend2") - c1))})
    d = d.withColumn("condition30", F.coalesce(F.col("dis") / F.col("hhll") > 0.333, F.lit(False)))
    cols = ["closed1", "closed2", "closed3", "highd1", "highd2", "lowd1", "lowd2", "opend2", "opend",
            "dcavg3", "distance", "hhll", "dis", "condition30"]
    return bars.join(d.select(*keys, day, *cols), [*keys, day], "left").withColumnRenamed("opend", "opend0")


def intraday_counters(bars: DataFrame, keys: Sequence[str], day: str = "trading_day", block=None) -> DataFrame:
    """E6 bar ordinal ``k`` in the day, running day high/low, E7 counts of
    higher highs / lower lows (vs the previous bar, which may be yesterday's
    last) within the day."""
    keys = list(keys)
    x = rolling(bars, keys, lambda w: {"_h1": F.lag("high", 1).over(w), "_l1": F.lag("low", 1).over(w),
                                       "_c1": F.lag("close", 1).over(w)}, 1, block=block)
    wd = Window.partitionBy(*keys, day).orderBy("ts")
    run = wd.rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumns({
        "k": F.row_number().over(wd),
        "highd0": F.max("high").over(run), "lowd0": F.min("low").over(run),
        "n_hh": F.sum(F.coalesce((F.col("high") > F.col("_h1")).cast("int"), F.lit(0))).over(run),
        "n_ll": F.sum(F.coalesce((F.col("low") < F.col("_l1")).cast("int"), F.lit(0))).over(run)})


def breakout_orders(x: DataFrame, l_ratio: float = 0.8, s_ratio: float = 0.6) -> DataFrame:
    """Entry orders per bar — direction, contracts and stop price — under
    the bar-number window 1 < k < 58.  Whether an order is still allowed (one
    entry a day, E18) depends on fills and is decided in :func:`breakout_entries`."""
    h, l_, c, o0 = F.col("high"), F.col("low"), F.col("close"), F.col("opend0")
    c1, dist, dc = F.col("closed1"), F.col("distance"), F.col("dcavg3")
    cond30 = F.col("condition30")
    k = F.col("k")
    window = (k > 1) & (k < 58)
    long_ = (window & (h > c1 + dist * l_ratio) & ((l_ + c) / 2 > F.greatest(o0, dc))
             & (o0 > c1 - dist * s_ratio) & (c > F.col("_c1"))
             & (l_ > F.when(cond30, F.lit(0.0)).otherwise(F.greatest("highd1", "highd2"))))
    short = (window & (l_ < c1 - dist * s_ratio) & ((h + c) / 2 < F.least(o0, dc))
             & (o0 < c1 + dist * l_ratio) & (c < F.col("_c1"))
             & (h < F.when(cond30, F.lit(9999999.0)).otherwise(F.least("lowd1", "lowd2"))))
    side = F.when(F.coalesce(long_, F.lit(False)), 1).when(F.coalesce(short, F.lit(False)), -1).otherwise(0)
    qty = F.when(side == 1, F.when(F.col("n_hh") >= k * 0.5, 2).otherwise(1)) \
        .when(side == -1, F.when(F.col("n_ll") >= k * 0.5, 2).otherwise(1)).otherwise(0)
    late = (k > 30) | cond30
    stop = F.when(side == 1, F.when(late, F.col("highd0")).otherwise(h)) \
        .when(side == -1, F.when(late, F.col("lowd0")).otherwise(l_))
    return x.withColumns({"order_side": side.cast("int"), "order_qty": qty.cast("int"), "order_stop": stop,
                          "sod": seconds_of_day("ts")})


def breakout_entries(bars: DataFrame, keys: Sequence[str] = ("symbol",), l_ratio: float = 0.8,
                     s_ratio: float = 0.6, day: str = "trading_day", block=None) -> DataFrame:
    """G12 + E18 on day-session bars carrying ``day``: the first entry of each key
    and day.  A bar's order is a stop for the next bar of the day; it fills where
    that bar reaches the stop, at the stop or at a worse open."""
    keys = list(keys)
    x = breakout_orders(intraday_counters(prior_day_features(bars, keys, day), keys, day, block=block), l_ratio, s_ratio)
    w = Window.partitionBy(*keys, day).orderBy("ts")
    x = x.withColumns({f"next_{c}": F.lead(c, 1).over(w) for c in ("ts", "open", "high", "low")})
    side, stop = F.col("order_side"), F.col("order_stop")
    price = F.when((side == 1) & (F.col("next_high") >= stop), F.greatest(stop, F.col("next_open"))) \
        .when((side == -1) & (F.col("next_low") <= stop), F.least(stop, F.col("next_open")))
    filled = x.withColumn("entry_price", price).where(F.col("entry_price").isNotNull())
    first = filled.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return first.select(*keys, day, F.col("ts").alias("order_ts"), F.col("next_ts").alias("entry_ts"),
                        F.col("order_side").alias("side"), F.col("order_qty").alias("qty"), "entry_price", "k")
