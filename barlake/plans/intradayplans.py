"""Named plans: intraday features and the prior-range breakout on 5-minute day-session bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.operators import bars as br
from barlake.operators import intraday as it
from barlake.operators import sessions as ss
from barlake.operators.sequence import sequence
from barlake.plans.common import round_doubles
from barlake.sources import fixtures as fx

KEYS = ["symbol"]


def _plain_bars5(spark, sf_dir):
    b = br.resample_ohlc(fx.minute_bars(spark, sf_dir), "5m", KEYS)
    b = b.where(ss.is_day("ts"))                           # B5 data view: day session
    return b.withColumn("trading_day", F.to_date("ts"))    # C2 for day-session bars


def _day_bars5(spark, sf_dir):
    return sequence(_plain_bars5(spark, sf_dir), KEYS, ["ts"])


def prior_day_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = it.prior_day_features(_plain_bars5(spark, sf_dir), KEYS)
    return round_doubles(x.select("symbol", "ts", "closed1", "closed2", "closed3", "highd1", "highd2", "lowd1",
                                  "lowd2", "opend2", "opend0", "dcavg3", "distance", "hhll", "dis",
                                  "condition30"))


def intraday_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, bl = _day_bars5(spark, sf_dir)
    x = it.intraday_counters(b, KEYS, block=bl)
    return round_doubles(x.select("symbol", "ts", "k", "highd0", "lowd0", "n_hh", "n_ll"))


def breakout_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G12 + E18: the first filled breakout entry of each symbol and day."""
    b, bl = _day_bars5(spark, sf_dir)
    return round_doubles(it.breakout_entries(b, KEYS, block=bl))


def session_rules_daytrade_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMA-cross signals on 5-minute day bars under the day-trading class:
    entries only inside 08:45–13:25, the 13:39 bar marked for the forced exit."""
    from barlake.operators import backtest as bt
    from barlake.operators import signals as sg
    b, bl = _day_bars5(spark, sf_dir)
    s = sg.ma_cross(b, KEYS, 5, 20, block=bl)
    r = bt.apply_rules_and_force_close(s, "daytrade_day")
    return r.select("symbol", "ts", "signal", "entry_signal", "exit_marker")


SESSION_KEYS = ["session_class", "symbol"]


def _session_ledger(spark, sf_dir, block=None):
    """SMA-cross signals on minute bars under both day-trading classes, each in its own
    view: entries inside the opening window, forced exits, fills at opens."""
    from barlake.operators import backtest as bt
    from barlake.operators import signals as sg
    from barlake.session import materialize
    bars = materialize(fx.minute_bars(spark, sf_dir))
    views = [ss.data_view(bars, c).withColumn("session_class", F.lit(c)) for c in ss.FLAT_TIMES]
    x, bl = sequence(views[0].unionByName(views[1]), SESSION_KEYS, ["ts"], **({"block": block} if block else {}))
    x = sg.ma_cross(x, SESSION_KEYS, 5, 20, block=bl)
    x = x.withColumn("signal", F.when(ss.can_open("ts", "session_class"), F.col("signal")).otherwise(F.lit(0)))
    parts = [ss.force_exit(x.where(F.col("session_class") == c), SESSION_KEYS, c, block=bl) for c in ss.FLAT_TIMES]
    return bt.backtest_open(parts[0].unionByName(parts[1]), SESSION_KEYS, exit_marker="exit_marker", block=bl)


def session_trades(spark: SparkSession, sf_dir: str, block=None) -> DataFrame:
    """H8 in the ledger: the trades of both day-trading classes, forced exits marked."""
    from barlake.operators import backtest as bt
    return round_doubles(bt.open_trades(_session_ledger(spark, sf_dir, block), SESSION_KEYS), 2)


def session_backtest(spark: SparkSession, sf_dir: str, block=None) -> DataFrame:
    """H8: result of each class and symbol, and the bars that still hold a position at
    their close from the flat time to the session's end (none may)."""
    led = _session_ledger(spark, sf_dir, block)
    cls = F.col("session_class")
    flat = F.when(cls == "daytrade_day", ss.flat_time(F.col("ts"), "daytrade_day")) \
        .otherwise(ss.flat_time(F.col("ts"), "daytrade_night"))
    out = led.groupBy(*SESSION_KEYS).agg(
        F.count(F.lit(1)).alias("n_bars"), F.count("trade_pnl").alias("n_trades"), F.count_if("forced").alias("n_forced"),
        F.count_if((F.col("position") != 0) & (F.col("ts") >= flat)).alias("n_held_past_flat"),
        F.sum("trade_pnl").alias("pnl"), F.max_by("equity", "_ord").alias("final_equity"),
        F.min("drawdown").alias("max_drawdown"))
    return round_doubles(out.withColumn("pnl", F.round("pnl", 2)), 6)
