"""Named plans over bars: resampling, sessions, trading day, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.operators import bars as br
from barlake.operators import quality as qa
from barlake.operators import sessions as ss
from barlake.operators.sequence import sequence
from barlake.plans.common import round_doubles
from barlake.sources import bars_csv as bc
from barlake.sources import fixtures as fx

KEYS = ["symbol"]


def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(fx.minute_bars(spark, sf_dir))


def resample(tf: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(br.resample_ohlc(fx.minute_bars(spark, sf_dir), tf, KEYS))
    q.__name__ = f"resample_ohlc_{tf}"
    return q


def session_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2–B4, B6, B7 flags on every tick (fractional seconds matter at the edges)."""
    t = fx.ticks(spark, sf_dir)
    cols = {"session_type": ss.classify_session("ts"),
            "in_day_slice": ss.is_day("ts", False),
            "in_night_slice": ss.is_night("ts", False)}
    for c, _, _, _ in ss.SESSION_CLASSES:
        cols[f"open_{c}"] = ss.can_open("ts", F.lit(c))
        cols[f"close_{c}"] = ss.must_force_close("ts", F.lit(c))
    return t.select("event_id", "symbol", "ts", *[v.alias(k) for k, v in cols.items()])


def session_slice_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(ss.session_slice(fx.minute_bars(spark, sf_dir), "day"))


def trading_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3 on ticks: bars inside day ∪ night (half-open)."""
    return round_doubles(ss.filter_trading_sessions(fx.ticks(spark, sf_dir)))


def trading_day_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2 on ticks (batch tail mode)."""
    t = fx.ticks(spark, sf_dir)
    return round_doubles(ss.assign_trading_day(t, KEYS).select(
        "event_id", "symbol", "ts", "trading_day", "session_type"))


def next_trading_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.next_trading_day(fx.ticks(spark, sf_dir), KEYS)


def _flagged(spark, sf_dir):
    mb, bl = sequence(fx.minute_bars(spark, sf_dir), KEYS, ["ts"])
    return qa.flag_bars(mb, KEYS, block=bl)


def bar_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _flagged(spark, sf_dir)
    return round_doubles(f.select("symbol", "ts", "prev_close", "is_null", "is_ohlc_error",
                                  "is_jump", "is_anomaly"))


def bar_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(qa.detect_gaps(_flagged(spark, sf_dir), KEYS))


def bar_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(qa.quality_report(_flagged(spark, sf_dir), KEYS))


def symbol_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return br.symbol_summary(fx.minute_bars(spark, sf_dir))


def bars_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 on stored-style day bars: one symbol, an inclusive date range."""
    return round_doubles(br.bars_between(fx.day_bars(spark, sf_dir), "1-URGENT",
                                         "1996-01-01", "1996-12-31"))


def minute_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute bars with trading day, session type and the month partition
    column the table is written by."""
    from barlake.sources.bars_csv import build_minute_table
    return round_doubles(build_minute_table(fx.minute_bars(spark, sf_dir)).select(
        "symbol", "ts", "open", "high", "low", "close", "trading_day", "session_type", "trading_day_month"))


def _bar_folder(spark: SparkSession, sf_dir: str) -> str:
    """Minute bars as CSV files in the shared folder, one folder per symbol: compact
    lines for some symbols, a header with date and time for others."""
    import uuid

    from barlake.session import ensure_checkpoint_dir
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bars-{uuid.uuid4().hex[:12]}"
    b = fx.minute_bars(spark, sf_dir)
    text = [F.format_string("%.6f", F.col(c)).alias(c) for c in ("open", "high", "low", "close")]
    compact = F.length("symbol") % 2 == 0
    clock = (F.hour("ts") * 100 + F.minute("ts")).cast("string")        # 901 for 09:01
    b.where(compact).select("symbol", F.date_format("ts", "yyyyMMdd").alias("d"), clock.alias("t"), *text) \
        .write.partitionBy("symbol").csv(f"{folder}/compact")
    b.where(~compact).select("symbol", F.date_format("ts", "yyyy/MM/dd").alias("Date"),
                             F.date_format("ts", "HH:mm:ss").alias("Time"), *text) \
        .write.partitionBy("symbol").option("header", True).csv(f"{folder}/headed")
    return folder


def bar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1–A4: the minute bars read back from files of both formats."""
    folder = _bar_folder(spark, sf_dir)
    parts = [bc.read_bars_dir(spark, f"{folder}/{kind}", nested=True)[0] for kind in ("compact", "headed")]
    return round_doubles(parts[0].unionByName(parts[1]))


def bar_file_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last date of the headed files as text, and the rows of January."""
    folder = _bar_folder(spark, sf_dir)
    span = bc.csv_date_range(spark, f"{folder}/headed/*/*.csv")
    rows = bc.scan_csv(spark, f"{folder}/headed/*/*.csv", "2024-01-01", "2024-01-10", columns=["Date", "Time", "close"])
    return span.crossJoin(rows.agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.col("Date").cast("string")).alias("first")))
