"""Streams on engine state: late rows, alerts before the end, horizons."""
import datetime as dt

import pyarrow as pa

from pyspark.sql import functions as F

from barlake.operators import bars as br
from barlake.sources import fixtures as fx
from barlake.streaming import streams

SF = "/root/testdata/sf0.001"


def _rows(df, cols=("symbol", "ts", "open", "high", "low", "close")):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def test_bars_in_order_equal_batch_and_nothing_is_late(spark):
    ticks = fx.ticks(spark, SF)
    bars, late = streams.stream_bars(streams.in_time_order(ticks, "ts", 4), 5)
    assert late == 0
    assert _rows(bars) == _rows(br.ticks_to_bars(ticks, "5m"))


def test_late_ticks_are_dropped_and_counted(spark, tmp_path):
    ticks = fx.ticks(spark, SF)
    mid = dt.datetime(2024, 1, 15)
    # the engine judges lateness by the watermark of one micro-batch before
    newest = dt.datetime(2024, 1, 20)
    for part in (ticks.where(F.col("ts") >= F.lit(newest)), ticks.where((F.col("ts") >= F.lit(mid)) & (F.col("ts") < F.lit(newest))),
                 ticks.where(F.col("ts") < F.lit(mid))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    feed = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    bars, late = streams.stream_bars(feed, 5)
    n_old = ticks.where(F.col("ts") < F.lit(mid)).count()
    assert late == n_old > 0
    assert _rows(bars) == _rows(br.ticks_to_bars(ticks.where(F.col("ts") >= F.lit(mid)), "5m"))


def test_alerts_come_out_before_the_input_ends(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    trades = streams._as_trades(li)
    spark_out, late = streams.stream_alerts(streams._as_trades(streams.in_time_order(li, "l_shipdate", 4)), lateness="30 days")
    want = streams.alert_rows(trades, spark.createDataFrame([], streams._STATE), 500_000.0, 0.2)
    key = lambda df: sorted((r.strategy, r.orderkey, r.linenumber, r.loss_streak, round(r.dd_ratio, 6), r.level) for r in df.collect())
    assert key(spark_out) == key(want)
    assert late.count() == 0


def test_most_trades_are_settled_by_timers(spark, tmp_path, monkeypatch):
    """What the sink holds when the query stops, before the waiting trades are finished."""
    sunk = []
    real = streams._append

    def spy(df, out, chk):
        n = real(df, out, chk)
        sunk.append((n, df.sparkSession.read.schema(streams._ALERT).parquet(out).count()))
        return n

    monkeypatch.setattr(streams, "_append", spy)
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    streams.stream_alerts(streams._as_trades(streams.in_time_order(li, "l_shipdate", 4)), lateness="30 days")
    (read, settled), = sunk
    assert read == li.count() and 0.9 * read < settled < read


_TRADES = "strategy long, exit_ts timestamp_ntz, orderkey long, linenumber int, pnl double"


def _fed(spark, folder, rows, parts):
    """A stream of trades, ``parts`` files in order of time."""
    df = spark.createDataFrame(rows, _TRADES)
    return df, streams.in_time_order(df.coalesce(1), "exit_ts", parts)


def _shown(df):
    return sorted(repr((r.strategy, r.exit_ts, r.orderkey, r.linenumber, r.pnl, r.loss_streak, round(r.dd_ratio, 6), r.level)) for r in df.collect())


def test_alert_state_does_not_grow_by_strategy(spark, tmp_path, monkeypatch):
    """The engine holds a key per group (F11: its calls cost per key and micro-batch)."""
    keys = {}
    real = streams._left

    def spy(spark, chk, name=None):
        df = real(spark, chk, name)
        keys[name] = df.select("key").distinct().count()
        return df

    monkeypatch.setattr(streams, "_left", spy)
    rows = [(k % 90, dt.datetime(2020, 1, 1) + dt.timedelta(days=k // 6), k, k % 7, float((k * 37) % 11 - 6)) for k in range(900)]
    df, feed = _fed(spark, tmp_path, rows, 3)
    got, late = streams.stream_alerts(feed, 50.0, 0.2, "20 days", groups=5)
    assert _shown(got) == _shown(streams.alert_rows(df, spark.createDataFrame([], streams._STATE), 50.0, 0.2))
    assert late.count() == 0 and keys["state"] <= 5 and keys["waiting"] <= 5


def test_alerts_keep_null_keys(spark, tmp_path):
    """A null strategy is one strategy; other ids beside a null stay what they are."""
    rows = [((None, 3, 2**60 + 1)[k % 3], dt.datetime(2020, 1, 1) + dt.timedelta(days=k), None if k % 10 == 9 else 2**60 + k,
             None if k % 4 == 1 else k, float((k * 5) % 7 - 4)) for k in range(60)]
    df, feed = _fed(spark, tmp_path, rows, 3)
    got, late = streams.stream_alerts(feed, 50.0, 0.2, "9 days", groups=2)
    assert _shown(got) == _shown(streams.alert_rows(df, spark.createDataFrame([], streams._STATE), 50.0, 0.2))
    assert late.count() == 0


def test_packed_trades_come_back_whole():
    rows = [{"group": k % 3, "strategy": k % 6 if k % 5 else None, "at": k * 10 if k % 4 else None, "orderkey": 2**60 + k, "linenumber": None, "pnl": k / 3}
            for k in range(25)]
    schema = pa.schema([("group", pa.int32()), ("strategy", pa.int64()), ("at", pa.int64()), ("orderkey", pa.int64()),
                        ("linenumber", pa.int32()), ("pnl", pa.float64())])
    batches = pa.Table.from_pylist(rows, schema).to_batches(max_chunksize=4)
    packed = list(streams._pack_trades(10)(iter(batches)))
    assert sum(b.num_rows for b in packed) == 7      # three groups in each 12 rows, one in the last row
    back = [r for b in packed for r in pa.Table.from_batches(list(streams._unpack_trades()(iter([b.select(["trades"])])))).to_pylist()]
    assert sorted(back, key=lambda r: r["orderkey"]) == [{c: r[c] for c in streams._PACKED} for r in rows]
    for b in packed:
        for r in b.to_pylist():
            times = [t["at"] for t in pa.ipc.open_stream(r["trades"]).read_all().to_pylist() if t["at"] is not None]
            assert r["first"] == (min(times) if times else None)


def test_dedup_horizon(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, text, t0 + dt.timedelta(hours=h)) for i, (text, h) in enumerate(
        [("a", 0), ("a", 1), ("b", 2), ("a", 30), ("b", 31), ("c", 60), ("a", 61), ("a", 90)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, at timestamp")
    for lo, hi in ((0, 3), (3, 5), (5, 7), (7, 8)):
        df.where(F.col("doc_id").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
    feed = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "d"))
    kept = sorted(r.doc_id for r in streams.stream_dedup(feed(), "at", "10 hours").collect())
    # "a" of hour 0 is forgotten at the end of the third micro-batch, whose watermark is hour 21
    assert kept == [0, 2, 5, 7] or kept == [1, 2, 5, 7]
    assert len(streams.stream_dedup(feed()).collect()) == 3
