"""Named plans: walk-forward analysis of the SMA cross over a parameter grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.operators import backtest as bt
from barlake.operators import indicators as ind
from barlake.operators import metrics as mt
from barlake.operators import walkforward as wf
from barlake.operators.sequence import rolling, sequence
from barlake.operators.signals import _ma_valid, _raw_to_signal
from barlake.plans.backtests import KEYS
from barlake.plans.common import round_doubles
from barlake.session import content_key, materialize, reuse
from barlake.sources import fixtures as fx

# The reference's example grid
GRID = {"fast_period": [10, 20, 30], "slow_period": [40, 60, 80]}
TRAIN, TEST = 24, 6


def _segments(bars: DataFrame):
    wins = wf.wfa_windows(bars, KEYS, TRAIN, TEST)
    mem = wf.window_members(bars, wins, KEYS, TRAIN, TEST)
    kept = wf.keep_windows(mem, KEYS)
    mem = mem.join(kept.select(*KEYS, "k"), [*KEYS, "k"], "left_semi")
    return mem, kept


def segment_metrics(spark: SparkSession, sf_dir: str, contract: bt.Contract = bt.Contract()) -> tuple[DataFrame, DataFrame]:
    """H10's measures of every (symbol, window, segment, combo) and the windows.  They
    are stored under a key of the bars' content, the grid and the contract, so the plans
    that need them share one computation, and other bars are computed anew."""
    # the daily bar table is the stored input of every window, segment and
    # combo: aggregated once from the orders scan and written to the shared
    # checkpoint folder, then read by the key, window and membership steps
    bars = materialize(fx.day_bars(spark, sf_dir))
    key = content_key(bars, GRID, TRAIN, TEST, contract)
    kept = reuse(spark, key, "windows", lambda: _segments(bars)[1])
    return reuse(spark, key, "segments", lambda: _computed(spark, bars, contract)), kept


def _computed(spark: SparkSession, bars: DataFrame, contract: bt.Contract) -> DataFrame:
    mem, _ = _segments(bars)
    seg = KEYS + ["k", "segment"]
    x, bl = sequence(mem.select(*seg, "ts", "open", "high", "low", "close"), seg, ["ts"],
                     bucket=F.date_trunc("month", F.col("ts")))
    lengths = sorted(set(GRID["fast_period"]) | set(GRID["slow_period"]))
    # one mean column per distinct length, shared by every combo of the segment
    x = rolling(x, seg, lambda w: {f"sma_{n}": ind.w_mean("close", n, w) for n in lengths},
                max(lengths) - 1, block=bl)
    grid = wf.param_grid(spark, GRID, _ma_valid)
    x = wf.with_combos(x, GRID, _ma_valid)

    def pick(col: str):
        e = None
        for n in GRID[col]:
            e = F.when(F.col(col) == n, F.col(f"sma_{n}")) if e is None else e.when(F.col(col) == n, F.col(f"sma_{n}"))
        return e

    x = x.withColumn("_above", F.coalesce(pick("fast_period") > pick("slow_period"), F.lit(False)))
    x = x.drop(*[f"sma_{n}" for n in lengths])
    keys2 = seg + ["combo_idx"]

    def s2(w):
        up, down = ind.cross_flags(F.col("_above"), F.lag("_above", 1).over(w))
        return {"raw_signal": _raw_to_signal(up, down)}

    def s3(w):
        return {"signal": F.coalesce(F.lag("raw_signal", 1).over(w), F.lit(0)).cast("int")}

    sig = rolling(x, keys2, [s2, s3], 2, block=bl)
    led = bt.backtest(sig, keys2, contract, block=bl)
    return mt.metrics_all(led, keys2).join(F.broadcast(grid), "combo_idx")


def wfa_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, kept = segment_metrics(spark, sf_dir)
    best = wf.pick_best(m, KEYS, ["fast_period", "slow_period"])
    out = kept.join(best, [*KEYS, "k"], "inner").drop("k")
    return round_doubles(out, 6)


def wfa_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, kept = segment_metrics(spark, sf_dir)
    best = wf.pick_best(m, KEYS, ["fast_period", "slow_period"])
    return round_doubles(wf.wfa_summary(best, KEYS), 6)


def wfa_segment_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (symbol, window, segment, combo) back-test: the grid behind H10."""
    m, kept = segment_metrics(spark, sf_dir)
    out = m.join(kept.select(*KEYS, "k", "window_idx"), [*KEYS, "k"]).drop("k")
    return round_doubles(out.select(*KEYS, "window_idx", "segment", "combo_idx", "fast_period",
                                    "slow_period", "sharpe", "max_drawdown", "profit_factor",
                                    "total_trades", "final_equity", "n_bars"), 6)
