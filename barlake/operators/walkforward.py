"""Walk-forward analysis.

* Windows (H9) are built per key on a calendar-bounded table: the cursor
  advances by ``test`` months cumulatively (a clipped day stays clipped:
  31 Aug → 28/29 Feb → 28/29 Aug), in-sample ends ``train`` months after the
  cursor, out-of-sample ``test`` months after that; generation stops when the
  out-of-sample end passes the last bar + 1 day; windows need > 100 IS and
  > 10 OOS bars.
* Bars join windows through an exploded candidate window id (C9): a bar can
  only belong to the ⌈(train+test)/test⌉+1 windows whose months cover it, so
  the range join is an equi-join on ``(key, k)``.
* The parameter grid (C10) is a small literal frame, cross-joined as a
  broadcast (its size is the grid's, not the data's).  Indicators restart in
  every segment: each (key, window, segment, combo) is its own sequence.
* Best in-sample combo: highest Sharpe, first combo on ties, NULL never wins,
  floor 0; out-of-sample Sharpe with that combo; ratio = oos/is if is > 0
  else 0 (H10).  Summary (D11) gives the mean of ratios and the ratio of means.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlake.functions.timecols import day_start

OOS_IS_RATIO_MIN = 0.6


def param_grid(spark: SparkSession, grid: dict[str, list],
               validator: Callable[[dict], bool] | None = None) -> DataFrame:
    """C10 + K17: all combinations in key order with ``combo_idx``; invalid
    combinations (per ``validator``) are dropped before they reach a job."""
    keys = list(grid)
    rows = []
    for i, combo in enumerate(itertools.product(*[grid[k] for k in keys])):
        p = dict(zip(keys, combo))
        if validator is None or validator(p):
            rows.append((i, *combo))
    schema = ", ".join(["combo_idx int"] + [f"{k} {'double' if any(isinstance(v, float) for v in grid[k]) else 'int'}"
                                           for k in keys])
    return spark.createDataFrame(rows, schema)


def with_combos(df: DataFrame, grid: dict[str, list],
                validator: Callable[[dict], bool] | None = None) -> DataFrame:
    """C10 as a generator: every row fans out to the valid combos of the
    literal grid (``combo_idx`` + one column per parameter)."""
    keys = list(grid)
    combos = []
    for i, combo in enumerate(itertools.product(*[grid[k] for k in keys])):
        p = dict(zip(keys, combo))
        if validator is None or validator(p):
            combos.append(F.struct(F.lit(i).alias("combo_idx"), *[F.lit(v).alias(k) for k, v in p.items()]))
    x = df.withColumn("_combo", F.explode(F.array(*combos)))
    return x.select("*", "_combo.*").drop("_combo")


def _micros_of_day(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", day_start(ts), ts)


def wfa_windows(bars: DataFrame, keys: Sequence[str], train_months: int = 24, test_months: int = 6,
                ts: str = "ts") -> DataFrame:
    """H9: candidate windows per key: ``k, cursor, is_end, oos_end`` (before the
    bar-count filter, see :func:`window_members`)."""
    keys = list(keys)
    span = bars.groupBy(*keys).agg(F.min(ts).alias("_t0"), F.max(ts).alias("_t1"))
    span = span.withColumns({"_m0": F.trunc(F.to_date("_t0"), "month"),
                             "_tod": _micros_of_day(F.col("_t0")),
                             "_kmax": (F.floor(F.months_between(F.to_date("_t1"), F.to_date("_t0"))
                                               / F.lit(test_months)) + 1).cast("int")})
    x = span.select("*", F.explode(F.sequence(F.lit(0), F.col("_kmax"))).alias("k"))
    mk = F.add_months(F.col("_m0"), F.col("k") * test_months)
    x = x.withColumn("_dim", F.when(F.col("k") == 0, F.dayofmonth(F.to_date("_t0")))
                     .otherwise(F.dayofmonth(F.last_day(mk))))
    w = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_day", F.least(F.dayofmonth(F.to_date("_t0")), F.min("_dim").over(w)))
    cur = F.make_date(F.year(mk), F.month(mk), F.col("_day"))

    def at(d: Column) -> Column:
        return F.timestamp_add("MICROSECOND", F.col("_tod"), d.cast("timestamp_ntz"))

    x = x.withColumns({"cursor": at(cur), "is_end": at(F.add_months(cur, train_months))})
    x = x.withColumn("oos_end", at(F.add_months(F.add_months(cur, train_months), test_months)))
    x = x.where(F.col("oos_end") <= F.timestamp_add("DAY", F.lit(1), F.col("_t1")))
    return x.select(*keys, "k", "cursor", "is_end", "oos_end", "_m0")


def window_members(bars: DataFrame, windows: DataFrame, keys: Sequence[str], train_months: int = 24,
                   test_months: int = 6, ts: str = "ts") -> DataFrame:
    """Every (bar, window) membership with ``segment`` 'is' / 'oos'."""
    keys = list(keys)
    m0 = windows.groupBy(*keys).agg(F.min("_m0").alias("_m0"))
    b = bars.join(m0, keys, "inner")  # one row per key
    months = (F.year(ts) - F.year("_m0")) * 12 + F.month(ts) - F.month("_m0")
    k_hi = F.floor(months / F.lit(test_months)).cast("int")
    k_lo = F.greatest(F.floor((months - F.lit(train_months + test_months)) / F.lit(test_months)).cast("int")
                      - 1, F.lit(0))
    b = b.withColumn("k", F.explode(F.sequence(k_lo, F.greatest(k_hi, k_lo)))).drop("_m0")
    j = b.join(windows.drop("_m0"), [*keys, "k"], "inner")
    j = j.where((F.col(ts) >= F.col("cursor")) & (F.col(ts) < F.col("oos_end")))
    return j.withColumn("segment", F.when(F.col(ts) < F.col("is_end"), F.lit("is")).otherwise(F.lit("oos")))


def keep_windows(members: DataFrame, keys: Sequence[str], ts: str = "ts", min_is: int = 100,
                 min_oos: int = 10) -> DataFrame:
    """Window table with bar counts and segment dates; only windows with
    enough bars, numbered ``window_idx`` from 1 per key."""
    keys = list(keys)
    seg = F.col("segment")
    g = members.groupBy(*keys, "k").agg(
        F.count_if(seg == "is").alias("n_is"), F.count_if(seg == "oos").alias("n_oos"),
        F.min(F.when(seg == "is", F.col(ts))).alias("is_start"),
        F.max(F.when(seg == "is", F.col(ts))).alias("is_last"),
        F.min(F.when(seg == "oos", F.col(ts))).alias("oos_start"),
        F.max(F.when(seg == "oos", F.col(ts))).alias("oos_last"))
    g = g.where((F.col("n_is") > min_is) & (F.col("n_oos") > min_oos))
    w = Window.partitionBy(*keys).orderBy("k")
    return g.withColumn("window_idx", F.row_number().over(w)).select(
        *keys, "k", "window_idx", "n_is", "n_oos",
        *[F.to_date(c).alias(c.replace("_last", "_end")) for c in ("is_start", "is_last", "oos_start", "oos_last")])


def pick_best(seg_metrics: DataFrame, keys: Sequence[str], combo_cols: Sequence[str]) -> DataFrame:
    """Best in-sample combo per (key, k) and its out-of-sample Sharpe."""
    keys = list(keys)
    is_ = seg_metrics.where(F.col("segment") == "is")
    w = Window.partitionBy(*keys, "k").orderBy(F.col("sharpe").desc_nulls_last(), F.col("combo_idx"))
    best = is_.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") == 1).select(
        *keys, "k", "combo_idx", *combo_cols,
        F.greatest(F.coalesce(F.col("sharpe"), F.lit(0.0)), F.lit(0.0)).alias("is_sharpe"))
    oos = seg_metrics.where(F.col("segment") == "oos").select(*keys, "k", "combo_idx",
                                                                F.col("sharpe").alias("oos_sharpe"))
    out = best.join(oos, [*keys, "k", "combo_idx"], "left")
    return out.withColumn("ratio", F.when(F.col("is_sharpe") > 0, F.col("oos_sharpe") / F.col("is_sharpe"))
                          .otherwise(F.lit(0.0)))


def wfa_summary(windows: DataFrame, keys: Sequence[str], ratio_min: float = OOS_IS_RATIO_MIN) -> DataFrame:
    """Means, mean of ratios (legacy) and ratio of means (current rules),
    both flags.  A NULL ratio (no OOS Sharpe) makes the mean NULL and the flag
    false, as a NaN does in the reference."""
    keys = list(keys)

    def strict_avg(c: str) -> Column:
        return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))

    g = windows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_windows"),
                                   strict_avg("is_sharpe").alias("avg_is_sharpe"),
                                   strict_avg("oos_sharpe").alias("avg_oos_sharpe"),
                                   strict_avg("ratio").alias("avg_ratio"),
                                   F.count_if(F.col("ratio") >= ratio_min).alias("windows_passed"))
    rom = F.when(F.col("avg_is_sharpe") > 0, F.col("avg_oos_sharpe") / F.col("avg_is_sharpe")) \
        .otherwise(F.lit(0.0))
    return g.withColumns({
        "overfitting": F.coalesce(F.col("avg_ratio") < ratio_min, F.lit(False)),
        "ratio_of_means": rom,
        "overfitting_rom": F.coalesce(rom < ratio_min, F.lit(False))})


def overfit_flag(is_sharpe: Column, oos_sharpe: Column, ratio_min: float = OOS_IS_RATIO_MIN) -> Column:
    """oos/is below the minimum; always true when is ≤ 0."""
    return F.when(is_sharpe <= 0, F.lit(True)).otherwise(
        F.coalesce(oos_sharpe / is_sharpe < ratio_min, F.lit(True)))
