"""Named plans running the streaming operators to completion (availableNow)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barlake.plans.common import round_doubles
from barlake.sources import fixtures as fx
from barlake.streaming import streams


def stream_resample_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(streams.run_stream_resample(spark, sf_dir, 5))


def stream_bars_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 on engine state: ticks in time order, bars written as the watermark passes."""
    bars, _ = streams.stream_bars(streams.in_time_order(fx.ticks(spark, sf_dir), "ts", 4), 5)
    return round_doubles(bars)


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: trades in time order, final 30 days behind the newest one."""
    feed = streams.in_time_order(streams._as_trades(fx.table(spark, sf_dir, "lineitem")), "exit_ts", 4)
    return round_doubles(streams.stream_alerts(feed, lateness="30 days")[0])


def stream_dedup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.run_stream_dedup(spark, sf_dir)
