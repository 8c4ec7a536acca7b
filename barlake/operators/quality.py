"""Bar data quality: jumps, gaps, anomalies and the summary report
(D12, E8–E10).

Thresholds (fixed values of the reference): gap > 5 minutes inside a session,
open-vs-previous-close jump > 5 %.  Gap sessions use the half-open bounds of
the legacy validator; a 04:59 → 15:00 same-date pair counts as a night gap
there (both ends are night hours, dates differ by ≤ 1) — kept for parity,
``strict_night=True`` drops it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.functions.timecols import seconds_between
from barlake.operators import sessions as ss
from barlake.operators.sequence import rolling

MAX_GAP_MINUTES = 5.0
MAX_PRICE_JUMP = 0.05


def flag_bars(df: DataFrame, keys: Sequence[str], jump: float = MAX_PRICE_JUMP,
              block=None) -> DataFrame:
    """Add ``prev_close``, ``prev_ts``, ``is_null``, ``is_ohlc_error``,
    ``is_jump`` and ``is_anomaly``."""
    x = rolling(df, keys, lambda w: {"prev_close": F.lag("close", 1).over(w),
                                     "prev_ts": F.lag("ts", 1).over(w)}, 1, block=block)
    o, h, lo, c = (F.col(k) for k in ("open", "high", "low", "close"))
    is_null = o.isNull() | h.isNull() | lo.isNull() | c.isNull()
    err = F.coalesce(h < lo, F.lit(False)) | F.coalesce(o <= 0, F.lit(False)) | \
        F.coalesce(c <= 0, F.lit(False))
    pc = F.col("prev_close")
    j = F.try_divide(F.abs(o - pc), F.when(pc != 0, pc))
    is_jump = F.coalesce(j > F.lit(jump), F.lit(False))
    return x.withColumns({"is_null": is_null, "is_ohlc_error": err, "is_jump": is_jump,
                          "is_anomaly": is_null | err | is_jump})


def gap_session(prev_ts, ts, strict_night: bool = False):
    """'day' / 'night' / 'cross-session' for two adjacent bar times."""
    p_day, n_day = ss.is_day(prev_ts, False), ss.is_day(ts, False)
    p_ngt, n_ngt = ss.is_night(prev_ts, False), ss.is_night(ts, False)
    dd = F.datediff(F.to_date(ts), F.to_date(prev_ts))
    night = p_ngt & n_ngt & (dd <= 1)
    if strict_night:
        # the evening part must come first: early → (same or next date) late/early
        night = night & ~(ss.is_night_late(prev_ts, False) & ss.is_night_early(ts, False) & (dd == 0))
    return (F.when(p_day & n_day & (dd == 0), F.lit("day"))
            .when(night, F.lit("night")).otherwise(F.lit("cross-session")))


def detect_gaps(flagged: DataFrame, keys: Sequence[str], max_gap_minutes: float = MAX_GAP_MINUTES,
                strict_night: bool = False) -> DataFrame:
    """Adjacent bars further apart than ``max_gap_minutes`` inside one
    session (cross-session pauses dropped). Input: :func:`flag_bars` output."""
    mins = seconds_between("prev_ts", "ts") / F.lit(60.0)
    g = flagged.where(F.col("prev_ts").isNotNull() & (mins > F.lit(max_gap_minutes)))
    g = g.select(*keys, F.col("prev_ts").alias("gap_start"), F.col("ts").alias("gap_end"),
                 mins.alias("gap_minutes"), gap_session("prev_ts", "ts", strict_night).alias("session"))
    return g.where(F.col("session") != "cross-session")


def quality_report(flagged: DataFrame, keys: Sequence[str],
                   max_gap_minutes: float = MAX_GAP_MINUTES) -> DataFrame:
    """One row per key with counts, rates, gap count and date range.
    Gaps are counted in the same aggregate pass (no second scan)."""
    mins = seconds_between("prev_ts", "ts") / F.lit(60.0)
    is_gap = (F.col("prev_ts").isNotNull() & (mins > F.lit(max_gap_minutes))
              & (gap_session("prev_ts", "ts") != "cross-session"))
    g = flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_bars"),
        F.count_if("is_null").alias("null_count"),
        F.count_if("is_ohlc_error").alias("ohlc_error_count"),
        F.count_if("is_jump").alias("price_jump_count"),
        F.count_if("is_anomaly").alias("anomaly_count"),
        F.count_if(is_gap).alias("gap_count"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return g.withColumns({
        "valid_bars": F.col("total_bars") - F.col("anomaly_count"),
        "null_rate": F.col("null_count") / F.col("total_bars"),
        "anomaly_rate": F.col("anomaly_count") / F.col("total_bars")})
