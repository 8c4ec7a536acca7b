"""Batch = stream on any file layout: one file or four, in order or reversed."""
import time

import pytest
from pyspark.sql import functions as F

from barlake.operators import bars as br
from barlake.sources import fixtures as fx
from barlake.streaming import streams

SF = "/root/testdata/sf0.001"


def _layout(spark, folder, table, order, parts, reverse):
    """A copy of a table in ``parts`` files by ``order``, older files first or last."""
    df = spark.read.parquet(f"{SF}/{table}.parquet")
    rank = F.percent_rank().over(streams.Window.orderBy(order))
    cut = df.withColumn("_p", F.least(F.floor(rank * parts), F.lit(parts - 1)).cast("int")).cache()
    for k in (range(parts - 1, -1, -1) if reverse else range(parts)):
        cut.where(F.col("_p") == k).drop("_p").coalesce(1).write.mode("append").parquet(f"{folder}/{table}.parquet")
        time.sleep(1.1)     # the stream takes files by modification time
    return str(folder)


LAYOUTS = [(1, False), (4, False), (4, True)]


@pytest.mark.parametrize("parts,reverse", LAYOUTS)
def test_stream_resample_equals_batch(spark, tmp_path, parts, reverse):
    d = _layout(spark, tmp_path, "events", "ts", parts, reverse)
    rows = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r)
                             for r in df.select("symbol", "ts", "open", "high", "low", "close").collect())
    assert rows(streams.run_stream_resample(spark, d, 5)) == rows(br.ticks_to_bars(fx.ticks(spark, SF), "5m"))


def test_late_ticks_are_counted(spark, tmp_path):
    d = _layout(spark, tmp_path, "events", "ts", 2, True)
    ev = streams.read_stream(spark, d, "events")
    ticks = ev.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), "event_id")
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    late = streams.stream_resample(ticks, 5).agg(F.sum("n_late")).first()[0]
    assert 0.4 * n < late < 0.6 * n


def _alerts(df):
    return sorted((r.strategy, r.orderkey, r.linenumber, r.loss_streak, round(r.dd_ratio, 6), r.level) for r in df.collect())


@pytest.mark.parametrize("parts,reverse", LAYOUTS)
def test_stream_alerts_equal_batch(spark, tmp_path, parts, reverse):
    d = _layout(spark, tmp_path, "lineitem", "l_shipdate", parts, reverse)
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    trades = li.select(F.col("l_suppkey").alias("strategy"), F.col("l_shipdate").alias("exit_ts"), F.col("l_orderkey").alias("orderkey"),
                       F.col("l_linenumber").alias("linenumber"), (F.col("l_extendedprice") * (F.col("l_discount") - F.lit(0.05))).alias("pnl"))
    batch = streams.alert_rows(trades, spark.createDataFrame([], streams._STATE), 500_000.0, 0.2)
    assert _alerts(streams.run_stream_alerts(spark, d)) == _alerts(batch)


def test_state_is_carried_and_late_trades_are_kept_aside(spark, tmp_path):
    rows = [(1, f"2020-01-{day:02d} 00:00:00", day, 1, -1.0 if day % 4 else 5.0) for day in range(1, 13)]
    df = spark.createDataFrame(rows, "strategy long, t string, orderkey long, linenumber int, pnl double") \
        .select("strategy", F.col("t").cast("timestamp_ntz").alias("exit_ts"), "orderkey", "linenumber", "pnl")
    for days in ((1, 2, 3, 4), (6, 5, 7, 8), (2, 9, 10, 11, 12)):     # the second 2 comes too late
        df.where(F.col("orderkey").isin(*days)).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
        time.sleep(1.1)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    got, late = streams.stream_alerts(stream, 100.0, 0.2, "1 days")
    want = streams.alert_rows(df, spark.createDataFrame([], streams._STATE), 100.0, 0.2)
    assert _alerts(got) == _alerts(want)
    assert [r.orderkey for r in late.collect()] == [2]


@pytest.mark.parametrize("parts,reverse", LAYOUTS)
def test_stream_dedup_distinct(spark, tmp_path, parts, reverse):
    d = _layout(spark, tmp_path, "documents", "doc_id", parts, reverse)
    s = [r.content_hash for r in streams.run_stream_dedup(spark, d).collect()]
    want = {r[0] for r in fx.table(spark, SF, "documents").select(F.sha2("text", 256)).distinct().collect()}
    assert len(s) == len(want) and set(s) == want
