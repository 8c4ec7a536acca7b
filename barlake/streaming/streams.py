"""Structured Streaming forms of resampling, alerting and de-duplication
(M1–M3; these are extensions — the reference has no stream operators).

Each helper starts a query with ``trigger(availableNow=True)`` whose sink and state
lie below the session's checkpoint folder.  State is the engine's own, keyed and in
RocksDB: windows under a watermark (M1 ``stream_bars``), a small state of each strategy
and the waiting trades, by groups of strategies with event-time timers (M2), the hashes
seen (M3).
A micro-batch reads and writes the state of its own keys only.  When the input ends,
what still waits in the state is read with the state reader and finished as a batch.
``stream_resample`` keeps no state: its sink holds mergeable parts, so it is exact
for any order of files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from barlake.functions.timecols import instant_to_wall, wall_to_instant
from barlake.session import ensure_checkpoint_dir


def _paths(spark: SparkSession, name: str) -> tuple[str, str]:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    run = f"{base}/streams/{name}-{uuid.uuid4().hex[:12]}"
    return f"{run}/out", f"{run}/chk"


def read_stream(spark: SparkSession, sf_dir: str, table: str, max_files: int = 1) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .parquet(f"{sf_dir}/{table}[.]parquet"))


def _run(df: DataFrame, chk: str, step: Callable[[DataFrame, int], None]) -> None:
    q = (df.writeStream.foreachBatch(step).option("checkpointLocation", chk)
         .trigger(availableNow=True).start())
    q.awaitTermination()


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def _rocksdb(spark: SparkSession):
    """State of queries started inside lies in RocksDB."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _append(df: DataFrame, out: str, chk: str) -> int:
    """Run a stateful query into a Parquet sink; the number of rows it read."""
    read: dict[int, int] = {}
    with _rocksdb(df.sparkSession):
        q = (df.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", chk)
             .trigger(availableNow=True).start())
        while True:
            done = q.awaitTermination(2)
            for p in q.recentProgress:
                read[p["batchId"]] = max(read.get(p["batchId"], 0), p["numInputRows"])
            if done:
                return sum(read.values())


def _sunk(spark: SparkSession, out: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(out) if _exists(spark, out) else spark.createDataFrame([], schema)


def _left(spark: SparkSession, chk: str, name: str | None = None) -> DataFrame | None:
    """The state at the end of a query (None: nothing was read)."""
    if not _exists(spark, f"{chk}/state"):
        return None
    reader = spark.read.format("statestore")
    return (reader if name is None else reader.option("stateVarName", name)).load(chk)


def in_time_order(df: DataFrame, order: str, parts: int) -> DataFrame:
    """A stream over the rows of a table, dealt by ``order`` to ``parts`` files that come
    one after the other."""
    spark = df.sparkSession
    path = _paths(spark, "feed")[0]
    cuts = df.select(F.unix_micros(wall_to_instant(order)).alias("at")).agg(F.percentile_approx(
        "at", [k / parts for k in range(1, parts)], 1000)).first()[0] or []
    place = sum((F.unix_micros(wall_to_instant(order)) > c).cast("int") for c in cuts) if cuts else F.lit(0)
    for k in range(len(cuts) + 1):
        df.where(place == k).write.mode("append").parquet(path)
    # a file per trigger would split a part that was written in several tasks
    files = max(1, len(spark.read.parquet(path).inputFiles()) // (len(cuts) + 1))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def _epoch_path(folder: str, epoch: int) -> str:
    return f"{folder}/epoch={epoch}"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


# --------------------------------------------------------------------------
# M1: streaming resample
# --------------------------------------------------------------------------

def partial_bars(ticks: DataFrame, minutes: int) -> DataFrame:
    """Mergeable bars: the first and last tick with their place, the range, the count."""
    width = minutes * 60
    sod = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    start = F.date_trunc("day", "ts") + F.make_dt_interval(secs=(F.floor(sod / width) * width).cast("decimal(18,6)"))
    place = F.struct("ts", "event_id")
    return ticks.groupBy("symbol", start.cast("timestamp_ntz").alias("ts_bar")).agg(
        F.min(F.struct(place.alias("at"), F.col("price"))).alias("first"), F.max("price").alias("high"),
        F.min("price").alias("low"), F.max(F.struct(place.alias("at"), F.col("price"))).alias("last"),
        F.sum("late").alias("n_late"))


def merged_bars(parts: DataFrame) -> DataFrame:
    """One bar per symbol and bin from the parts of all epochs."""
    g = parts.groupBy("symbol", F.col("ts_bar").alias("ts")).agg(
        F.min("first")["price"].alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max("last")["price"].alias("close"), F.sum("n_late").alias("n_late"))
    return g.select("symbol", "ts", "open", "high", "low", "close", "n_late")


def stream_resample(ticks: DataFrame, minutes: int, lateness: str = "10 minutes") -> DataFrame:
    """M1: tumbling OHLC bars on wall-clock time.  Every micro-batch adds its partial
    bars to the sink; a reader merges them, so a tick that comes after its bar was
    first written still counts.  ``n_late`` is the number of ticks of a bar that came
    more than ``lateness`` behind the newest tick of the epochs before."""
    spark = ticks.sparkSession
    out, chk = _paths(spark, f"resample{minutes}")
    schema = partial_bars(spark.createDataFrame([], ticks.schema).withColumn("late", F.lit(0).cast("long")), minutes).schema

    def step(batch: DataFrame, epoch: int) -> None:
        # one row, from the epoch before: the newest tick so far
        before = _epoch_path(f"{out}-newest", epoch - 1)
        newest = spark.read.schema("ts timestamp_ntz").parquet(before).first()[0] if epoch and _exists(spark, before) else None
        late = F.lit(0) if newest is None else (
            F.col("ts") < F.lit(newest).cast("timestamp_ntz") - F.expr(f"interval {lateness}")).cast("int")
        partial_bars(batch.withColumn("late", late.cast("long")), minutes).write.mode("overwrite").parquet(_epoch_path(out, epoch))
        batch.agg(F.greatest(F.max("ts"), F.lit(newest).cast("timestamp_ntz")).alias("ts")) \
            .write.mode("overwrite").parquet(_epoch_path(f"{out}-newest", epoch))

    _run(ticks, chk, step)
    return merged_bars(spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out))


def run_stream_resample(spark: SparkSession, sf_dir: str, minutes: int = 5) -> DataFrame:
    ev = read_stream(spark, sf_dir, "events")
    ticks = ev.select(F.col("event_type").alias("symbol"), "ts",
                      (F.lit(10000.0) + F.col("value")).alias("price"), "event_id")
    return stream_resample(ticks, minutes).drop("n_late")


_BAR = "struct<ts:timestamp_ntz,event_id:bigint,price:double>"


def stream_bars(ticks: DataFrame, minutes: int, lateness: str = "10 minutes") -> tuple[DataFrame, int]:
    """M1 on engine state: (bars, number of ticks that came too late).  A bar is written
    once, when the watermark (newest tick of the micro-batches before, less ``lateness``)
    passes its end, and leaves the state; bars still open when the input ends are taken
    from the state.  Ticks whose bar ended before the watermark of one micro-batch before
    are dropped and counted: they are the rows read that no bar holds.  ``minutes`` divides a day."""
    if 1440 % minutes:
        raise ValueError("the width of streamed bars must divide a day")
    spark = ticks.sparkSession
    out, chk = _paths(spark, f"bars{minutes}")
    tick = F.struct("ts", "event_id", "price")
    grouped = ticks.withColumn("at", wall_to_instant("ts")).withWatermark("at", lateness) \
        .groupBy("symbol", F.window("at", f"{minutes} minutes").alias("bar")).agg(
            F.min(tick).alias("first"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max(tick).alias("last"), F.count(F.lit(1)).alias("n_ticks"))
    read = _append(grouped, out, chk)

    def shown(df: DataFrame) -> DataFrame:
        return df.select("symbol", instant_to_wall("bar.start").alias("ts"), F.col("first.price").alias("open"), "high", "low",
                         F.col("last.price").alias("close"), "n_ticks")

    bars = shown(_sunk(spark, out, grouped.schema))
    left = _left(spark, chk)
    if left is not None:
        value = F.col("value").cast(f"struct<first:{_BAR},high:double,low:double,last:{_BAR},n_ticks:bigint>").alias("v")
        bars = bars.unionByName(shown(left.select("key.symbol", F.col("key.window").alias("bar"), value).select("symbol", "bar", "v.*")))
    return bars, read - (bars.agg(F.sum("n_ticks")).first()[0] or 0)


# --------------------------------------------------------------------------
# M2: streaming health alerts (stateful)
# --------------------------------------------------------------------------

_ORDER = ["exit_ts", "orderkey", "linenumber"]
_STATE = "strategy long, streak long, equity double, peak double"


def _level(streak: Column, dd: Column) -> Column:
    from barlake.operators.metrics import HEALTH_LEVELS
    out = F.lit("green")
    for name, n, ratio in reversed(HEALTH_LEVELS):
        out = F.when((streak >= n) | (dd >= ratio), name).otherwise(out)
    return out


def alert_rows(trades: DataFrame, state: DataFrame, capital: float, dd_limit: float) -> DataFrame:
    """Alerts of final trades, each strategy going on from its state (losing streak,
    equity, peak); ``state`` may lack strategies."""
    w = Window.partitionBy("strategy").orderBy(*_ORDER)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    known = state.withColumnRenamed("strategy", "_known")
    x = trades.join(known, F.col("strategy").eqNullSafe(F.col("_known")), "left").drop("_known").fillna(capital, ["equity", "peak"]).fillna(0, ["streak"])
    x = x.withColumn("_n", F.row_number().over(w)).withColumn("_win", F.max(F.when(~(F.col("pnl") < 0), F.col("_n"))).over(run))
    x = x.withColumn("loss_streak", F.when(F.col("_win").isNull(), F.col("streak") + F.col("_n")).otherwise(F.col("_n") - F.col("_win")))
    x = x.withColumn("equity", F.col("equity") + F.sum("pnl").over(run))
    x = x.withColumn("peak", F.greatest("peak", F.max("equity").over(run)))
    x = x.withColumn("dd_ratio", F.when(F.col("peak") != 0, (F.col("peak") - F.col("equity")) / F.col("peak") / dd_limit))
    return x.select("strategy", *_ORDER, "pnl", F.col("loss_streak").cast("long").alias("loss_streak"), "dd_ratio",
                    _level(F.col("loss_streak"), F.col("dd_ratio")).alias("level"), "equity", "peak")


_ALERT = ("strategy long, exit_ts timestamp_ntz, orderkey long, linenumber int, pnl double, loss_streak long, dd_ratio double, "
          "level string, late boolean")
# trades travel and wait in Arrow streams of a group's rows; times are microseconds
_PACKED = ["strategy", "at", "orderkey", "linenumber", "pnl"]
_PACKED_AS = "strategy long, at long, orderkey long, linenumber int, pnl double"
_SETTLED = _PACKED_AS + ", loss_streak long, dd_ratio double, level string, late boolean"
_KNOWN = "strategy array<long>, streak array<long>, equity array<double>, peak array<double>"


def _pack_trades(max_rows: int = 500_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow step: rows of ``_PACKED`` and their group in, per group and ``max_rows`` read
    one row with the first time and the trades as an Arrow stream out."""
    cols = list(_PACKED)

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        table = table.take(pc.sort_indices(table["group"])).combine_chunks()
        group = table["group"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        first, packed = [], []
        for lo, hi in zip(cuts, cuts[1:]):
            part = table.slice(lo, hi - lo).select(cols)
            first.append(pc.min(part["at"]).as_py())
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as to:
                to.write_table(part)
            packed.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(group[cuts[:-1]], pa.int32()), pa.array(first, pa.int64()), pa.array(packed, pa.binary())],
                                          ["group", "first", "trades"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= max_rows:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    return pack


def _unpack_trades() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The Arrow step back: a column of Arrow streams in, their rows out."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                yield from pa.ipc.open_stream(packed.as_buffer())

    return unpack


def alert_state(capital: float, dd_limit: float) -> StatefulProcessor:
    """The processor of M2.  Its class is made here, so that it travels by value: the
    process that prepares a stateful stream imports nothing of this package."""

    class AlertState(StatefulProcessor):
        """Per group of strategies: losing streak, equity and peak of each strategy, and the
        trades that wait for the watermark.  A timer at the earliest waiting trade settles all
        that are final."""

        def init(self, handle) -> None:
            self.handle = handle
            # a map, not a list: an append to a long list costs more the longer it is
            self.waiting = handle.getMapState("waiting", "place long", "trades binary")
            self.places = handle.getValueState("places", "used long")
            self.state = handle.getValueState("state", _KNOWN)
            self.timer = handle.getValueState("timer", "at long")

        @staticmethod
        def _packed(rows: pa.Table, size: int = 500_000) -> Iterator[bytes]:
            for lo in range(0, len(rows), size):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as to:
                    to.write_table(rows.slice(lo, size).combine_chunks())
                yield sink.getvalue().to_pybytes()

        def _wait(self, packed: Iterable[bytes]) -> None:
            used = (self.places.get() or (0,))[0]
            for used, trades in enumerate(packed, used + 1):
                self.waiting.updateValue((used,), (trades,))
            self.places.update((used,))

        @staticmethod
        def _shown(rows: pa.Table, streak, ratio, late: bool) -> pd.DataFrame:
            whole = {c: rows[c].to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get) for c in rows.column_names}
            return pd.DataFrame({**whole, "loss_streak": streak, "dd_ratio": ratio, "level": "", "late": late})

        def _wake(self, first: int) -> None:
            at = -(-first // 1000)   # ceiling in milliseconds
            known = self.timer.get()
            if known is None or at < known[0]:
                self.handle.registerTimer(at)
                self.timer.update((at,))

        @staticmethod
        def _final(rows: pa.Table, mark: int) -> tuple[pa.Table, pa.Table]:
            """Trades the watermark has reached, and the others (those without a time among them)."""
            final = pc.fill_null(pc.less_equal(rows["at"], mark), False)
            return rows.filter(final), rows.filter(pc.invert(final))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            mark, earliest, kept = timerValues.getCurrentWatermarkInMs() * 1000, None, []
            for batch in rows:
                for first, packed in zip(batch["first"], batch["trades"]):
                    first = None if pd.isna(first) else int(first)
                    if first is not None and first <= mark:
                        gone, fresh = self._final(pa.ipc.open_stream(packed).read_all(), mark)
                        yield self._shown(gone, 0, 0.0, True)
                        kept.extend(self._packed(fresh))
                        first = pc.min(fresh["at"]).as_py()
                    else:
                        kept.append(packed)
                    if first is not None and (earliest is None or first < earliest):
                        earliest = first
            self._wait(kept)
            if earliest is not None:
                self._wake(earliest)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            known = self.timer.get()
            if known is None or known[0] != expiredTimerInfo.getExpiryTimeInMs():
                return
            self.timer.clear()
            rows = pa.concat_tables([pa.ipc.open_stream(e[0]).read_all() for _, e in self.waiting.iterator()])
            final, rest = self._final(rows, timerValues.getCurrentWatermarkInMs() * 1000)
            self.waiting.clear()
            if len(rest):
                self._wait(self._packed(rest))
                first = pc.min(rest["at"]).as_py()
                if first is not None:
                    self._wake(first)
            if not len(final):
                return
            final = final.take(pc.sort_indices(final, [(c, "ascending") for c in _PACKED[:4]])).combine_chunks()
            strategy, pnl = final["strategy"], final["pnl"].to_numpy()
            ids, absent = pc.fill_null(strategy, 0).to_numpy(), pc.is_null(strategy).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(ids) != 0) | (np.diff(absent) != 0)) + 1).tolist(), len(pnl)]
            state = {s: v for s, *v in zip(*self.state.get() or ([], [], [], []))}
            streaks, ratio = np.empty(len(pnl), np.int64), np.empty(len(pnl))
            for lo, hi in zip(cuts, cuts[1:]):
                name = None if absent[lo] else int(ids[lo])
                streak, equity, peak = state.get(name, (0, capital, capital))
                part = pnl[lo:hi]
                n = np.arange(1, hi - lo + 1)
                last_win = np.maximum.accumulate(np.where(~(part < 0), n, 0))
                streaks[lo:hi] = np.where(last_win > 0, n - last_win, streak + n)
                curve = equity + np.cumsum(part)
                peaks = np.maximum(peak, np.maximum.accumulate(curve))
                ratio[lo:hi] = np.divide(peaks - curve, peaks, out=np.full(hi - lo, np.nan), where=peaks != 0) / dd_limit
                state[name] = (int(streaks[hi - 1]), float(curve[-1]), float(peaks[-1]))
            self.state.update((list(state), *(list(v) for v in zip(*state.values()))))
            yield self._shown(final, streaks, ratio, False)

        def close(self) -> None:
            pass

    return AlertState()


def stream_alerts(trades: DataFrame, capital: float = 500_000.0, dd_limit: float = 0.20,
                  lateness: str = "36500 days", groups: int = 256) -> tuple[DataFrame, DataFrame]:
    """M2: (alerts, late trades).  A trade waits until the watermark (newest trade less
    ``lateness``, by micro-batch) has reached it; then it is final, in time order, and
    moves its strategy's state of three numbers, and its alert is written.  A trade
    that comes when the watermark has already reached it is not applied; it is
    returned among the late ones.  Trades still waiting when the input ends are final
    then.  Strategies share the engine's keys, ``groups`` of them: state calls and timers
    cost per group and micro-batch, not per strategy.  A micro-batch holds one group's share
    of its own rows and of the waiting ones in one task; ``groups``, ``maxFilesPerTrigger``
    and ``lateness`` bound it."""
    spark = trades.sparkSession
    out, chk = _paths(spark, "alerts")
    # the watermark column itself stays out, or the engine would drop late rows unseen
    rows = trades.withColumn("_time", wall_to_instant("exit_ts")).withWatermark("_time", lateness).select(
        F.pmod(F.hash("strategy"), F.lit(groups)).alias("group"), "strategy", F.unix_micros("_time").alias("at"), "orderkey", "linenumber",
        F.coalesce("pnl", F.lit(float("nan"))).alias("pnl"))
    packed = rows.mapInArrow(_pack_trades(), "group int, first long, trades binary")
    settled = packed.groupBy("group").transformWithStateInPandas(alert_state(capital, dd_limit), _SETTLED, "append", "eventTime")
    exit_ts = instant_to_wall(F.timestamp_micros("at")).alias("exit_ts")
    _append(settled.select("strategy", exit_ts, *settled.columns[2:]), out, chk)
    sunk = _sunk(spark, out, _ALERT)
    done = sunk.where("NOT late").withColumn("dd_ratio", F.when(~F.isnan("dd_ratio"), F.col("dd_ratio")))
    done = done.withColumn("level", _level(F.col("loss_streak"), F.col("dd_ratio"))).drop("late")
    wait = _left(spark, chk, "waiting")
    if wait is not None:
        known = F.explode(F.arrays_zip(*[F.col(f"value.{c}").alias(c) for c in ("strategy", "streak", "equity", "peak")]))
        state = _left(spark, chk, "state").select(known.alias("s")).select("s.*")
        rest = wait.select("user_map_value.trades").mapInArrow(_unpack_trades(), _PACKED_AS).select("strategy", exit_ts, *_ORDER[1:], "pnl")
        done = done.unionByName(alert_rows(rest, state, capital, dd_limit).select(*done.columns))
    return done, sunk.where("late").select("strategy", *_ORDER, "pnl")


def _as_trades(li: DataFrame) -> DataFrame:
    return li.select(F.col("l_suppkey").cast("long").alias("strategy"), F.col("l_shipdate").alias("exit_ts"),
                     F.col("l_orderkey").cast("long").alias("orderkey"), F.col("l_linenumber").cast("int").alias("linenumber"),
                     (F.col("l_extendedprice") * (F.col("l_discount") - F.lit(0.05))).alias("pnl"))


def run_stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_alerts(_as_trades(read_stream(spark, sf_dir, "lineitem")))[0]


# --------------------------------------------------------------------------
# M3: streaming de-duplication
# --------------------------------------------------------------------------

def stream_dedup(docs: DataFrame, event_time: str | None = None, horizon: str | None = None) -> DataFrame:
    """M3: (content_hash, doc_id), the first row seen of each content hash.  The hashes
    are engine state, keyed and on disk, so a micro-batch looks up its own hashes only.
    Without a horizon the result is exact over the whole stream, for any arrival order.
    With ``event_time`` (timestamp) and ``horizon`` a hash is forgotten once the
    watermark is past its time plus the horizon: repeats within the horizon go."""
    spark = docs.sparkSession
    out, chk = _paths(spark, "dedup")
    hashed = docs.withColumn("content_hash", F.sha2("text", 256))
    if event_time is None:
        first = hashed.dropDuplicates(["content_hash"])
    else:
        first = hashed.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(["content_hash"])
    first = first.select("content_hash", "doc_id")
    _append(first, out, chk)
    return _sunk(spark, out, first.schema)


def run_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup(read_stream(spark, sf_dir, "documents")).select("content_hash")
