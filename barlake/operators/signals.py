"""Signal generators (G1–G11) and the strategy registry.

Each generator maps a bar frame with ``_ord`` to the same frame plus an
integer ``signal`` column in {1, -1, 0}, already delayed by one bar (E1:
``coalesce(lag(raw, 1), 0)``), so a signal acts on the bar after it formed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.operators import indicators as ind
from barlake.operators.sequence import rolling


def _raw_to_signal(up, down):
    return F.when(up, F.lit(1)).when(down, F.lit(-1)).otherwise(F.lit(0))


def delay(df: DataFrame, keys, raw: str = "raw_signal", out: str = "signal", n: int = 1,
          block=None) -> DataFrame:
    """Shift by n bars, 0-filled."""
    return rolling(df, keys, lambda w: {out: F.coalesce(F.lag(raw, n).over(w), F.lit(0))
                                        .cast("int")}, n, block=block)


def ma_cross(df: DataFrame, keys: Sequence[str], fast_period: int = 20, slow_period: int = 60,
             use_close: bool = True, block: int | None = None) -> DataFrame:
    """G1: simple-mean cross (boolean-lag flavour), delayed one bar."""
    if not (0 < fast_period < slow_period):
        raise ValueError("ma_cross needs 0 < fast_period < slow_period")
    price = "close" if use_close else "open"

    def s1(w):
        above = F.coalesce(ind.w_mean(price, fast_period, w) > ind.w_mean(price, slow_period, w),
                           F.lit(False))
        return {"_above": above}

    def s2(w):
        up, down = ind.cross_flags(F.col("_above"), F.lag("_above", 1).over(w))
        return {"raw_signal": _raw_to_signal(up, down)}

    def s3(w):
        return {"signal": F.coalesce(F.lag("raw_signal", 1).over(w), F.lit(0)).cast("int")}

    out = rolling(df, keys, [s1, s2, s3], slow_period - 1 + 2, block=block)
    return out.drop("_above", "raw_signal")


def _value_cross(a: str, b: str, w):
    """F10 value-lag flavour: a>b now and a<=b one bar earlier (null warm-up never fires)."""
    up = F.coalesce((F.col(a) > F.col(b)) & (F.lag(a, 1).over(w) <= F.lag(b, 1).over(w)), F.lit(False))
    down = F.coalesce((F.col(a) < F.col(b)) & (F.lag(a, 1).over(w) >= F.lag(b, 1).over(w)), F.lit(False))
    return up, down


def _gt(a, b):
    return F.coalesce(a > b, F.lit(False))


def _finish(df, keys, raw_cols: dict, lookback: int, block, drop=()):
    """Evaluate the raw signal (rolling stage) and delay it one bar."""
    out = rolling(df, keys, [raw_cols, lambda w: {"signal": F.coalesce(
        F.lag("raw_signal", 1).over(w), F.lit(0)).cast("int")}], lookback + 1, block=block)
    return out.drop("raw_signal", *drop)


def rsi_reversal(df: DataFrame, keys: Sequence[str], rsi_period: int = 14, oversold: float = 30,
                 overbought: float = 70, block=None) -> DataFrame:
    """RSI state machine (enter below/above the bands, leave at 50); the
    signal is the sign of the change of the held state, so closing a short
    emits +1 and closing a long -1.  Rows with a null RSI keep the state but
    record state 0 (as the reference loop does)."""
    from barlake.operators.sequence import Automaton3, scan
    d = ind.compute(df, keys, [("rsi", "rsi", rsi_period, "ratio")], block=block)
    r = F.col("rsi")
    nul = r.isNull()
    from0 = F.when(r < oversold, 1).when(r > overbought, -1).otherwise(0)
    m = {"m0": F.when(nul, -1).when(r <= 50, 0).otherwise(-1),
         "m1": F.when(nul, 0).otherwise(from0),
         "m2": F.when(nul, 1).when(r >= 50, 0).otherwise(1)}
    d = scan(d, keys, {"_st": (Automaton3(), m)}, block=block)
    d = d.withColumn("_state", F.when(nul, F.lit(0)).otherwise(F.col("_st_m1")))

    def raw(w):
        prev = F.lag("_state", 1).over(w)
        return {"raw_signal": F.coalesce(F.signum(F.col("_state") - prev).cast("int"), F.lit(0))}
    return _finish(d, keys, raw, 1, block, drop=("_st_m0", "_st_m1", "_st_m2", "_state"))


def dual_ema_cross(df, keys, fast_length: int = 12, slow_length: int = 26, atr_length: int = 14,
                   atr_threshold: float = 1.2, block=None) -> DataFrame:
    """Value-lag EMA cross confirmed by ATR > threshold × SMA(ATR, fast_length)."""
    d = ind.compute(df, keys, [("ema", "ema_fast", "close", fast_length), ("ema", "ema_slow", "close", slow_length),
                               ("atr", "atr", atr_length)], block=block)

    def raw(w):
        up, down = _value_cross("ema_fast", "ema_slow", w)
        vol = _gt(F.col("atr"), F.lit(atr_threshold) * ind.w_mean("atr", fast_length, w))
        return {"raw_signal": _raw_to_signal(up & vol, down & vol)}
    return _finish(d, keys, raw, fast_length, block)


def dual_ema_atr_trend(df, keys, ema_fast_len: int = 18, ema_slow_len: int = 55, adx_len: int = 14,
                       adx_thresh: float = 20, atr_len: int = 14, atr_mult: float = 2.2,
                       block=None) -> DataFrame:
    """Level signal — long while fast>slow and ADX>thr, short while not
    fast>slow (warm-up included) and ADX>thr.  Uses the ADX column."""
    d = ind.compute(df, keys, [("ema", "ema_fast", "close", ema_fast_len), ("ema", "ema_slow", "close", ema_slow_len),
                               ("adx", "", adx_len)], block=block)
    trend_up = _gt(F.col("ema_fast"), F.col("ema_slow"))
    ok = _gt(F.col("adx"), F.lit(adx_thresh))
    return _finish(d, keys, lambda w: {"raw_signal": _raw_to_signal(trend_up & ok, ~trend_up & ok)},
                   0, block)


def ema_adx(df, keys, fast_len: int = 9, slow_len: int = 21, adx_len: int = 14,
            adx_thresh: float = 25, block=None) -> DataFrame:
    """Value-lag EMA cross with ADX above the threshold."""
    d = ind.compute(df, keys, [("ema", "ema_fast", "close", fast_len), ("ema", "ema_slow", "close", slow_len),
                               ("adx", "", adx_len)], block=block)

    def raw(w):
        up, down = _value_cross("ema_fast", "ema_slow", w)
        strong = _gt(F.col("adx"), F.lit(adx_thresh))
        return {"raw_signal": _raw_to_signal(up & strong, down & strong)}
    return _finish(d, keys, raw, 1, block)


def macd_ma_trend(df, keys, macd_fast: int = 12, macd_slow: int = 26, macd_signal: int = 9,
                  ma_short: int = 20, ma_long: int = 60, block=None) -> DataFrame:
    """MACD value-lag cross agreeing with the SMA order, then held."""
    from barlake.operators.sequence import scan
    d = ind.compute(df, keys, [("macd", "", macd_fast, macd_slow, macd_signal)], block=block)

    def s1(w):
        up, down = _value_cross("macd", "macd_signal", w)
        bull = _gt(ind.w_mean("close", ma_short, w), ind.w_mean("close", ma_long, w))
        bear = _gt(ind.w_mean("close", ma_long, w), ind.w_mean("close", ma_short, w))
        return {"_cross": _raw_to_signal(up & bull, down & bear)}
    d = rolling(d, keys, s1, max(ma_long - 1, 1), block=block)
    d = scan(d, keys, {"_held": ind.hold_last("_cross")}, block=block)
    d = d.withColumn("raw_signal", F.coalesce(F.col("_held"), F.lit(0)))
    return _finish(d, keys, lambda w: {}, 0, block, drop=("_cross", "_held"))


def macd_rsi_trend(df, keys, ema_len: int = 20, macd_fast: int = 12, macd_slow: int = 26,
                   macd_sig: int = 9, rsi_len: int = 14, signal_line: str = "named",
                   block=None) -> DataFrame:
    """Close vs EMA, MACD value-lag cross, RSI (share form) vs 50.
    ``signal_line='positional'`` compares with the histogram, as the
    reference's by-position column pick does."""
    d = ind.compute(df, keys, [("ema", "ema_trend", "close", ema_len), ("macd", "", macd_fast, macd_slow, macd_sig),
                               ("rsi", "rsi", rsi_len, "share")], block=block)
    other = "macd_signal" if signal_line == "named" else "macd_hist"

    def raw(w):
        up, down = _value_cross("macd", other, w)
        c = F.col("close")
        long_ = _gt(c, F.col("ema_trend")) & up & _gt(F.col("rsi"), F.lit(50.0))
        short = _gt(F.col("ema_trend"), c) & down & _gt(F.lit(50.0), F.col("rsi"))
        return {"raw_signal": _raw_to_signal(long_, short)}
    return _finish(d, keys, raw, 1, block)


def macd_trend_confirm(df, keys, fast: int = 12, slow: int = 26, signal: int = 9,
                       ema_period: int = 50, block=None) -> DataFrame:
    """Boolean-lag MACD cross confirmed by close vs EMA."""
    d = ind.compute(df, keys, [("macd", "", fast, slow, signal), ("ema", "ema_trend", "close", ema_period)],
                    block=block)

    def raw(w):
        above = _gt(F.col("macd"), F.col("macd_signal"))
        below = _gt(F.col("macd_signal"), F.col("macd"))
        up = above & F.coalesce(F.lag(above, 1).over(w) == F.lit(False), F.lit(False))
        down = below & F.coalesce(F.lag(below, 1).over(w) == F.lit(False), F.lit(False))
        c = F.col("close")
        return {"raw_signal": _raw_to_signal(up & _gt(c, F.col("ema_trend")),
                                             down & _gt(F.col("ema_trend"), c))}
    return _finish(d, keys, raw, 1, block)


def trend_breakout(df, keys, ema_period: int = 50, breakout_window: int = 20,
                   atr_multiplier: float = 2.0, close_before: int = 30, prior: bool = False,
                   block=None) -> DataFrame:
    """Close beyond EMA and the rolling extreme; stop masks from running
    entry counts; the last ``close_before`` bars of each key are flattened.
    With ``prior=False`` (parity) the extreme includes the current bar, so no
    entry can fire; ``prior=True`` uses the bars before it."""
    from barlake.operators.sequence import Sum, scan
    d = ind.compute(df, keys, [("ema", "ema_trend", "close", ema_period), ("atr", "atr", 14)], block=block)

    def s1(w):
        hi = ind.w_max("high", breakout_window, w, prior)
        lo = ind.w_min("low", breakout_window, w, prior)
        c, e = F.col("close"), F.col("ema_trend")
        return {"_le": _gt(c, e) & _gt(c, hi), "_se": _gt(e, c) & _gt(lo, c),
                "_sl": _gt(e - F.lit(atr_multiplier) * F.col("atr"), c),
                "_ss": _gt(c, e + F.lit(atr_multiplier) * F.col("atr"))}
    d = rolling(d, keys, s1, breakout_window, block=block)
    d = scan(d, keys, {"_cle": (Sum(), F.col("_le").cast("long")),
                       "_cse": (Sum(), F.col("_se").cast("long")),
                       "_csl": (Sum(), F.col("_sl").cast("long")),
                       "_css": (Sum(), F.col("_ss").cast("long"))}, block=block)
    d = d.withColumns({"_inl": F.col("_cle") - F.col("_cse") - F.col("_csl"),
                       "_ins": F.col("_cse") - F.col("_cle") - F.col("_css")})
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    d = d.join(n, list(keys), "inner")

    def raw(w):
        stop = (F.col("_sl") & F.coalesce(F.lag("_inl", 1).over(w) > 0, F.lit(False))) | \
               (F.col("_ss") & F.coalesce(F.lag("_ins", 1).over(w) > 0, F.lit(False)))
        sig = _raw_to_signal(F.col("_le"), F.col("_se"))
        force = (F.col("_n") > close_before) & (F.col("_ord") >= F.col("_n") - close_before)
        return {"raw_signal": F.when(stop | force, F.lit(0)).otherwise(sig)}
    return _finish(d, keys, raw, 1, block, drop=("_le", "_se", "_sl", "_ss", "_cle", "_cse", "_csl",
                                                 "_css", "_inl", "_ins", "_n"))


def trend_catcher(df, keys, fast_ema: int = 9, slow_ema: int = 21, macd_fast: int = 12,
                  macd_slow: int = 26, macd_signal: int = 9, block=None) -> DataFrame:
    """Value-lag EMA cross with the MACD histogram sign."""
    d = ind.compute(df, keys, [("ema", "ema_fast", "close", fast_ema), ("ema", "ema_slow", "close", slow_ema),
                               ("macd", "", macd_fast, macd_slow, macd_signal)], block=block)

    def raw(w):
        up, down = _value_cross("ema_fast", "ema_slow", w)
        h = F.col("macd_hist")
        return {"raw_signal": _raw_to_signal(up & _gt(h, F.lit(0.0)), down & _gt(F.lit(0.0), h))}
    return _finish(d, keys, raw, 1, block)


def trend_filtered_ema(df, keys, ema_fast: int = 9, ema_slow: int = 18, adx_thresh: float = 22,
                       atr_period: int = 14, stop_atr_mult: float = 2.0, lookahead_stop: bool = True,
                       block=None) -> DataFrame:
    """Value-lag EMA cross, ADX(14) > thr, 30 < RSI(14) < 70, ATR present.
    The stop check looks at the *next* bar's low/high (``lead``), as the
    reference does; ``lookahead_stop=False`` turns that off."""
    d = ind.compute(df, keys, [("ema", "ema_fast", "close", ema_fast), ("ema", "ema_slow", "close", ema_slow),
                               ("adx", "", 14), ("rsi", "rsi", 14, "share"), ("atr", "atr", atr_period)],
                    block=block)

    def s1(w):
        up, down = _value_cross("ema_fast", "ema_slow", w)
        ok = _gt(F.col("adx"), F.lit(adx_thresh)) & _gt(F.col("rsi"), F.lit(30.0)) & \
            _gt(F.lit(70.0), F.col("rsi")) & F.col("atr").isNotNull()
        sig = _raw_to_signal(up & ok, down & ok)
        if lookahead_stop:
            ref = F.lag("close", 1).over(w)
            dist = F.lag("atr", 1).over(w) * F.lit(stop_atr_mult)
            ls = _gt(ref - dist, F.lead("low", 1).over(w)) & (sig == 1)
            ss_ = _gt(F.lead("high", 1).over(w), ref + dist) & (sig == -1)
            sig = F.when(ls | ss_, F.lit(0)).otherwise(sig)
        return {"raw_signal": sig}
    d = rolling(d, keys, s1, 1, 1, block=block)
    return _finish(d, keys, lambda w: {}, 0, block)


# --------------------------------------------------------------------------
# registry (U1–U3)
# --------------------------------------------------------------------------

@dataclass
class StrategySpec:
    name: str
    fn: Callable[..., DataFrame]
    defaults: dict
    category: str = ""
    holding_type: str = ""
    timeframe: str = ""
    validator: Callable[[dict], bool] | None = None
    description: str = ""
    kind: str = "columns"  # 'columns' (U1) or 'pandas' (U2)
    extra: dict = field(default_factory=dict)


REGISTRY: dict[str, StrategySpec] = {}


def register_strategy(name: str, fn, defaults: dict, validator=None, **meta) -> StrategySpec:
    """Register a column-expression strategy ``fn(bars, keys, **params)``."""
    spec = StrategySpec(name=name, fn=fn, defaults=dict(defaults), validator=validator, **meta)
    REGISTRY[name] = spec
    return spec


def get_strategy(name: str) -> StrategySpec:
    if name not in REGISTRY:
        raise KeyError(f"unknown strategy {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name]


def run_strategy(name: str, bars: DataFrame, keys: Sequence[str], params: dict | None = None,
                 block=None) -> DataFrame:
    spec = get_strategy(name)
    p = {**spec.defaults, **(params or {})}
    if spec.validator and not spec.validator(p):
        raise ValueError(f"invalid parameters for {name}: {p}")
    return spec.fn(bars, keys, block=block, **p)


def list_strategies(spark) -> DataFrame:
    """Registry metadata as a small DataFrame."""
    import json
    rows = [(s.name, s.category, s.holding_type, s.timeframe, json.dumps(s.defaults, sort_keys=True),
             s.kind, s.description) for s in REGISTRY.values()]
    return spark.createDataFrame(rows, "name string, category string, holding_type string, "
                                       "timeframe string, params string, kind string, description string")


def _ma_valid(p):
    f, s = p.get("fast_period", 1), p.get("slow_period", 1)
    return isinstance(f, int) and isinstance(s, int) and 0 < f < s


register_strategy("RSI_Reversal", rsi_reversal, {"rsi_period": 14, "oversold": 30, "overbought": 70},
                  lambda p: isinstance(p.get("rsi_period", 14), int) and p.get("rsi_period", 14) > 1
                  and 0 < p.get("oversold", 30) < p.get("overbought", 70) < 100,
                  category="mean_reversion")
register_strategy("DualEMACrossover", dual_ema_cross, {"fast_length": 12, "slow_length": 26,
                  "atr_length": 14, "atr_threshold": 1.2},
                  lambda p: 0 < p["fast_length"] < p["slow_length"], category="trend")
register_strategy("DualEMA_ATR_Trend", dual_ema_atr_trend, {"ema_fast_len": 18, "ema_slow_len": 55,
                  "adx_len": 14, "adx_thresh": 20, "atr_len": 14, "atr_mult": 2.2}, category="trend")
register_strategy("EMA_ADX_Trend", ema_adx, {"fast_len": 9, "slow_len": 21, "adx_len": 14,
                  "adx_thresh": 25}, lambda p: 0 < p["fast_len"] < p["slow_len"], category="trend")
register_strategy("MACD_MA_Trend", macd_ma_trend, {"macd_fast": 12, "macd_slow": 26, "macd_signal": 9,
                  "ma_short": 20, "ma_long": 60}, category="trend")
register_strategy("MACD_RSI_Trend", macd_rsi_trend, {"ema_len": 20, "macd_fast": 12, "macd_slow": 26,
                  "macd_sig": 9, "rsi_len": 14},
                  lambda p: all(isinstance(p[k], int) and p[k] > 0 for k in
                                ("ema_len", "macd_fast", "macd_slow", "macd_sig", "rsi_len"))
                  and p["macd_fast"] < p["macd_slow"], category="trend")
register_strategy("MACD_TrendConfirm", macd_trend_confirm, {"fast": 12, "slow": 26, "signal": 9,
                  "ema_period": 50}, lambda p: 0 < p["fast"] < p["slow"] and p["signal"] > 0,
                  category="trend")
register_strategy("TrendBreakout", trend_breakout, {"ema_period": 50, "breakout_window": 20,
                  "atr_multiplier": 2.0, "close_before": 30}, category="breakout")
register_strategy("TrendCatcher", trend_catcher, {"fast_ema": 9, "slow_ema": 21, "macd_fast": 12,
                  "macd_slow": 26, "macd_signal": 9}, category="trend")
register_strategy("TrendFilteredEMA", trend_filtered_ema, {"ema_fast": 9, "ema_slow": 18,
                  "adx_thresh": 22, "atr_period": 14, "stop_atr_mult": 2.0},
                  lambda p: 0 < p["ema_fast"] < p["ema_slow"] and p["adx_thresh"] > 0
                  and p["atr_period"] > 0 and p["stop_atr_mult"] > 0, category="trend")
register_strategy("MA_Cross", ma_cross, {"fast_period": 20, "slow_period": 60, "use_close": True},
                  _ma_valid, category="trend", description="simple-mean cross, long above / short below")


# --------------------------------------------------------------------------
# Pandas strategies over bounded periods
# --------------------------------------------------------------------------

def register_pandas_strategy(name: str, fn, defaults: dict, period: str = "day", **meta) -> StrategySpec:
    """Escape hatch for arbitrary per-series pandas code.  ``fn(pdf, **params)``
    gets one key's bars of one ``period`` ('day' or 'month', a bounded group)
    sorted by time and returns the raw signal Series; indicators restart in
    every period.  The runner delays the signal one bar inside the period."""

    def run(df: DataFrame, keys, block=None, **params):
        import pandas as pd
        trunc = F.to_date("ts") if period == "day" else F.trunc(F.to_date("ts"), "month")
        x = df.withColumn("_period", trunc)
        from pyspark.sql import types as T
        schema = T.StructType(x.schema.fields + [T.StructField("signal", T.IntegerType())])

        def per_group(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("ts").reset_index(drop=True)
            raw = pd.Series(fn(pdf, **params), index=pdf.index).fillna(0).astype(int)
            pdf["signal"] = raw.shift(1).fillna(0).astype("int32")
            return pdf
        return x.groupBy(*keys, "_period").applyInPandas(per_group, schema).drop("_period")

    return register_strategy(name, run, defaults, kind="pandas", **meta)
