"""Trading sessions, session classes and the data-inferred trading day
(B2–B8, C1, C2, C8).

Session bounds (fixed values of the reference's rules): day 08:45–13:45,
night 15:00–23:59:59 and 00:00–05:00.  ``classify_session`` uses inclusive
ends (current rules); ``session_slice`` / ``filter_trading_sessions`` use the
half-open form of the legacy store: day [08:45, 13:45), night [15:00, 24:00) ∪
[00:00, 05:00).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.timecols import hm, seconds_of_day

# Session bounds in seconds of day
DAY_START = hm(8, 45)
DAY_END = hm(13, 45)
NIGHT_START = hm(15, 0)
NIGHT_END = hm(23, 59, 59)
LATE_END = hm(5, 0)

DAY, NIGHT, NON = "day_session", "night_session", "non_trading"


def is_day(ts, inclusive_end: bool = True) -> Column:
    t = seconds_of_day(ts)
    return (t >= DAY_START) & ((t <= DAY_END) if inclusive_end else (t < DAY_END))


def is_night_early(ts, inclusive_end: bool = True) -> Column:
    t = seconds_of_day(ts)
    return (t >= NIGHT_START) & (t <= NIGHT_END) if inclusive_end else (t >= NIGHT_START)


def is_night_late(ts, inclusive_end: bool = True) -> Column:
    t = seconds_of_day(ts)
    return (t <= LATE_END) if inclusive_end else (t < LATE_END)


def is_night(ts, inclusive_end: bool = True) -> Column:
    return is_night_early(ts, inclusive_end) | is_night_late(ts, inclusive_end)


def classify_session(ts, inclusive_end: bool = True) -> Column:
    """B4: 'day_session' / 'night_session' / 'non_trading'."""
    return (F.when(is_day(ts, inclusive_end), F.lit(DAY))
            .when(is_night(ts, inclusive_end), F.lit(NIGHT)).otherwise(F.lit(NON)))


def session_slice(df: DataFrame, session: str = "all", ts: str = "ts") -> DataFrame:
    """B2: half-open slice 'all' / 'day' / 'night'."""
    if session == "day":
        return df.where(is_day(ts, False))
    if session == "night":
        return df.where(is_night(ts, False))
    return df


def filter_trading_sessions(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Keep day ∪ night bars (half-open bounds)."""
    return df.where(is_day(ts, False) | is_night(ts, False))


# --------------------------------------------------------------------------
# session classes
# --------------------------------------------------------------------------

# The four strategy session classes
SESSION_CLASSES = [
    # name, data view, force-close bar (HH:MM) or None, description
    ("daytrade_day", "day", "13:39", "open 08:45-13:25, cool-down 13:25-13:40, flat at 13:40 open"),
    ("daytrade_night", "night", "04:44", "open 15:00-04:25, cool-down 04:25-04:45, flat at 04:45 open"),
    ("swing_day", "day", None, "open 08:45-13:45, may hold overnight, night unseen"),
    ("swing_full", "all", None, "open in any trading time"),
]


def session_classes(spark) -> DataFrame:
    return spark.createDataFrame(SESSION_CLASSES, "session_class string, data_view string, "
                                                  "force_close string, description string")


def can_open(ts, session_class: Column | str) -> Column:
    """May a position be opened on this bar under the class?"""
    cls = F.col(session_class) if isinstance(session_class, str) else session_class
    t = seconds_of_day(ts)
    return (F.when(cls == "daytrade_day", (t >= DAY_START) & (t < hm(13, 25)))
            .when(cls == "daytrade_night", ((t >= NIGHT_START) & (t <= NIGHT_END)) | (t < hm(4, 25)))
            .when(cls == "swing_day", (t >= DAY_START) & (t <= DAY_END))
            .when(cls == "swing_full", classify_session(ts) != NON)
            .otherwise(F.lit(False)))


def must_force_close(ts, session_class: Column | str) -> Column:
    """The 13:39 (day) / 04:44 (night) bar; never for swing classes."""
    cls = F.col(session_class) if isinstance(session_class, str) else session_class
    t = seconds_of_day(ts)
    return (F.when(cls == "daytrade_day", t == hm(13, 39))
            .when(cls == "daytrade_night", t == hm(4, 44)).otherwise(F.lit(False)))


def data_view(df: DataFrame, session_class: str, ts: str = "ts") -> DataFrame:
    """Day-only, night-only or all bars for a class (inclusive bounds)."""
    view = {c: v for c, v, _, _ in SESSION_CLASSES}[session_class]
    if view == "day":
        return df.where(is_day(ts))
    if view == "night":
        return df.where(is_night(ts))
    return df.where(classify_session(ts) != NON)


def apply_session_rules(df: DataFrame, session_class: str, signal: str = "signal",
                        ts: str = "ts") -> DataFrame:
    """Entries only where the class allows opening; a separate
    ``exit_marker`` flags the force-close bar (fills at the next bar's open)."""
    cls = F.lit(session_class)
    allowed = can_open(ts, cls)
    return df.withColumns({
        "entry_signal": F.when(allowed, F.col(signal)).otherwise(F.lit(0)),
        "exit_marker": must_force_close(ts, cls)})


# When the day-trading classes are flat
FLAT_TIMES = {"daytrade_day": hm(13, 40), "daytrade_night": hm(4, 45)}


def flat_time(ts, session_class: str) -> Column:
    """When the class must be flat in the session that a bar belongs to (null: no session
    of the class).  A night session that opens at 15:00 ends on the next date."""
    cut = FLAT_TIMES[session_class]
    t, start = seconds_of_day(ts), F.to_date(ts).cast("timestamp_ntz")
    at = F.timestamp_add("MINUTE", F.lit(int(cut // 60)), start)
    if session_class == "daytrade_day":
        return F.when((t >= DAY_START) & (t <= DAY_END), at)
    return F.when(t >= NIGHT_START, F.timestamp_add("DAY", F.lit(1), at)).when(t <= LATE_END, at)


def force_exit(bars: DataFrame, keys: Sequence[str], session_class: str, ts: str = "ts", block=None) -> DataFrame:
    """H8 on bars of any width and with holes: ``exit_marker`` is true on the last bar
    before the class's flat time (13:39 and 04:44 on complete minute bars), so the
    exit is settled at the first open from then on."""
    from barlake.operators.sequence import lag_cols
    x = lag_cols(bars, keys, {"_next": (ts, -1)}, block)
    flat = flat_time(F.col(ts), session_class)
    last = (F.col(ts) < flat) & (F.col("_next").isNull() | (F.col("_next") >= flat))
    return x.withColumn("exit_marker", F.coalesce(last, F.lit(False))).drop("_next")


# --------------------------------------------------------------------------
# trading day
# --------------------------------------------------------------------------

def date_dimension(bars: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """One row per (key, calendar date) present in the bars with ``has_day``
    (a day-session bar exists that date, inclusive bounds) and ``next_day``:
    the first later date with day-session bars (C1), null at the tail.

    The window runs over the date dimension of a key (calendar-bounded)."""
    keys = list(keys)
    d = (bars.select(*keys, F.to_date(ts).alias("date"), is_day(ts).alias("_d"))
         .groupBy(*keys, "date").agg(F.max(F.col("_d").cast("int")).cast("boolean").alias("has_day")))
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(1, Window.unboundedFollowing)
    return d.withColumn("next_day", F.min(F.when(F.col("has_day"), F.col("date"))).over(w))


def assign_trading_day(bars: DataFrame, keys: Sequence[str], ts: str = "ts",
                       on_tail: str = "batch") -> DataFrame:
    """Add ``trading_day`` and ``session_type``.

    day bars → own date; early night (15:00–23:59:59) → next date with day
    bars; late night (00:00–05:00) → own date if it has day bars, else the
    next one; non-trading → null.  At the data tail (no later day-session
    date): ``on_tail='batch'`` gives early night null and late night its own
    date (the reference's batch form), ``'null'`` gives null for both,
    ``'error'`` raises (the scalar form).
    """
    keys = list(keys)
    dim = date_dimension(bars, keys, ts)
    b = bars.withColumn("date", F.to_date(ts)).join(dim, [*keys, "date"], "left")
    early, late = is_night_early(ts), is_night_late(ts)
    nxt = F.col("next_day")
    if on_tail == "error":
        nxt = F.coalesce(nxt, F.raise_error(F.concat(F.lit("no trading day after "),
                                                     F.col("date").cast("string"))).cast("date"))
    late_tail = F.col("date") if on_tail == "batch" else F.lit(None).cast("date")
    td = (F.when(is_day(ts), F.col("date"))
          .when(early, nxt)
          .when(late, F.when(F.col("has_day"), F.col("date"))
                .otherwise(F.coalesce(nxt, late_tail) if on_tail != "error" else nxt)))
    return (b.withColumns({"trading_day": td, "session_type": classify_session(ts)})
            .drop("date", "has_day", "next_day"))


def next_trading_day(bars: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """C1 as a table: every calendar date in the bars → next date with day bars."""
    return date_dimension(bars, keys, ts)
