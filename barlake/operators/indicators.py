"""Technical indicators over keyed bar sequences.

All functions take a frame that already carries ``_ord`` (see
:func:`barlake.operators.sequence.with_ordinal`) and the key columns, and
return the frame with new columns.  Windowed indicators run through
:func:`~barlake.operators.sequence.rolling`, recurrences (EMA, Wilder means,
the adjusted EWM) through :func:`~barlake.operators.sequence.scan`, so no key
has to fit in one task.

Null handling follows pandas: an indicator is null until its window is full;
comparisons involving a null are *false* (``coalesce(cond, false)``) before
they are lagged or negated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.operators.sequence import (ORD, Affine, Last, Sum, Window, rolling, scan)


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --------------------------------------------------------------------------
# window expressions (usable inside a rolling stage)
# --------------------------------------------------------------------------

def w_mean(x, n: int, w: Window) -> Column:
    """Mean of the last ``n`` rows, null unless all ``n`` are present."""
    fr = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c(x)).over(fr) == n, F.avg(c(x)).over(fr))


def w_max(x, n: int, w: Window, prior: bool = False) -> Column:
    """Highest of the last ``n`` rows incl. the current one, or the ``n`` before it."""
    fr = w.rowsBetween(-n, -1) if prior else w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c(x)).over(fr) == n, F.max(c(x)).over(fr))


def w_min(x, n: int, w: Window, prior: bool = False) -> Column:
    fr = w.rowsBetween(-n, -1) if prior else w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c(x)).over(fr) == n, F.min(c(x)).over(fr))


def w_std(x, n: int, w: Window, ddof: int = 0) -> Column:
    fr = w.rowsBetween(-(n - 1), 0)
    f = F.stddev_pop if ddof == 0 else F.stddev_samp
    return F.when(F.count(c(x)).over(fr) == n, f(c(x)).over(fr))


def w_pct_change(x, w: Window) -> Column:
    """E5: x / x[-1] - 1, null when the previous value is 0 or missing."""
    return F.try_divide(c(x), F.lag(c(x), 1).over(w)) - F.lit(1.0)


# --------------------------------------------------------------------------
# frame-level indicators
# --------------------------------------------------------------------------

def sma(df: DataFrame, keys: Sequence[str], x: str, n: int, out: str | None = None,
        block: int | None = None) -> DataFrame:
    out = out or f"sma_{n}"
    return rolling(df, keys, lambda w: {out: w_mean(x, n, w)}, n - 1, block=block)


def rolling_extremes(df, keys, x: str, n: int, prior: bool = False, block=None) -> DataFrame:
    """highest/lowest over n bars (``prior`` excludes the current bar)."""
    return rolling(df, keys, lambda w: {f"highest_{n}": w_max(x, n, w, prior),
                                        f"lowest_{n}": w_min(x, n, w, prior)},
                   n if prior else n - 1, block=block)


def bollinger(df, keys, x: str = "close", n: int = 20, k: float = 2.0, block=None) -> DataFrame:
    """mean ± k·population stdev over n bars."""
    def st(w):
        m = w_mean(x, n, w)
        s = w_std(x, n, w, 0)
        return {"bb_mid": m, "bb_upper": m + F.lit(k) * s, "bb_lower": m - F.lit(k) * s}
    return rolling(df, keys, st, n - 1, block=block)


def ema(df: DataFrame, keys: Sequence[str], x: str, n: int, out: str | None = None,
        alpha: float | None = None, block: int | None = None) -> DataFrame:
    """exponential mean seeded by the simple mean of the first ``n`` values.

    ``y[n-1] = mean(x[0..n-1])``, ``y[t] = (1-α)·y[t-1] + α·x[t]``; null before.
    α = 2/(n+1) unless given (Wilder: 1/n).  The recursion is an affine scan.
    """
    return ema_many(df, keys, {out or f"ema_{n}": (x, n, alpha)}, block=block)


def ema_many(df: DataFrame, keys: Sequence[str], spec: dict[str, tuple], block=None) -> DataFrame:
    """Several seeded EMAs ``{out: (x, n[, alpha])}`` in one rolling pass and one scan.

    ``x`` must be non-null from its first row on (a leading run of nulls is
    allowed: the seed then starts at the first non-null row — pass ``x`` already
    filtered to its valid rows, see :func:`ema_after_valid`).
    """
    keys = list(keys)
    spec = {o: (v[0], v[1], v[2] if len(v) > 2 else None) for o, v in spec.items()}
    look = max(n for _, n, _ in spec.values()) - 1
    seeds = rolling(df, keys, lambda w: {f"_seed_{o}": w_mean(x, n, w)
                                         for o, (x, n, _) in spec.items()}, look, block=block)
    parts = {}
    for o, (x, n, a) in spec.items():
        alpha = a if a is not None else 2.0 / (n + 1)
        o_ = F.col(ORD)
        parts[f"_e_{o}"] = (Affine(), {
            "a": F.when(o_ < n, F.lit(0.0)).otherwise(F.lit(1.0 - alpha)),
            "b": F.when(o_ < n - 1, F.lit(0.0)).when(o_ == n - 1, F.col(f"_seed_{o}"))
                  .otherwise(F.lit(alpha) * c(x))})
    out = scan(seeds, keys, parts, block=block)
    res = {o: F.when(F.col(ORD) >= n - 1, F.col(f"_e_{o}_b")) for o, (_, n, _) in spec.items()}
    drop = [f"_seed_{o}" for o in spec] + [f"_e_{o}_{f}" for o in spec for f in ("a", "b")]
    return out.withColumns(res).drop(*drop)


def ewm_mean(df: DataFrame, keys: Sequence[str], spec: dict[str, tuple], block=None) -> DataFrame:
    """pandas ``ewm(alpha, min_periods, adjust=True).mean()`` for each
    ``{out: (x, alpha, min_periods)}``.

    numerator ``N = (1-α)N + x`` and denominator ``D = (1-α)D + 1`` are affine
    scans (a missing x adds nothing to either; weights still decay, as with
    ``ignore_na=False``); the mean is ``N/D`` once ``min_periods`` values were seen.
    """
    parts = {}
    for o, (x, alpha, _) in spec.items():
        valid = c(x).isNotNull()
        parts[f"_n_{o}"] = (Affine(), {"a": F.lit(1.0 - alpha),
                                       "b": F.coalesce(c(x), F.lit(0.0))})
        parts[f"_d_{o}"] = (Affine(), {"a": F.lit(1.0 - alpha),
                                       "b": F.when(valid, 1.0).otherwise(0.0)})
        parts[f"_k_{o}"] = (Sum(), F.when(valid, 1).otherwise(0))
    out = scan(df, keys, parts, block=block)
    res = {o: F.when(F.col(f"_k_{o}") >= mp, F.col(f"_n_{o}_b") / F.col(f"_d_{o}_b"))
           for o, (_, _, mp) in spec.items()}
    drop = [f"_{p}_{o}_{f}" for o in spec for p in ("n", "d") for f in ("a", "b")] + \
           [f"_k_{o}" for o in spec]
    return out.withColumns(res).drop(*drop)


def rsi_ewm(df: DataFrame, keys, n: int = 14, out: str = "rsi", x: str = "close",
            style: str = "ratio", block=None) -> DataFrame:
    """RSI from ``ewm(com=n-1, min_periods=n, adjust=True)`` means of
    gains and losses.

    ``style='ratio'``: ``100 - 100/(1 + gain/loss)``, null when the mean loss is
    0 (the in-tree strategy).  ``style='share'``: ``100·gain/(gain+loss)``, 100
    when the mean loss is 0 (the indicator-library form).
    """
    d = rolling(df, keys, lambda w: {"_dx": c(x) - F.lag(c(x), 1).over(w)}, 1, block=block)
    d = d.withColumns({"_gain": F.when(F.col("_dx").isNull(), None).otherwise(F.greatest(F.col("_dx"), F.lit(0.0))),
                       "_loss": F.when(F.col("_dx").isNull(), None).otherwise(F.greatest(-F.col("_dx"), F.lit(0.0)))})
    alpha = 1.0 / n
    d = ewm_mean(d, keys, {"_ag": ("_gain", alpha, n), "_al": ("_loss", alpha, n)}, block=block)
    if style == "ratio":
        r = F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + F.try_divide(F.col("_ag"), F.nullif(F.col("_al"), F.lit(0.0))))
    else:
        r = F.lit(100.0) * F.try_divide(F.col("_ag"), F.col("_ag") + F.col("_al"))
    return d.withColumn(out, r).drop("_dx", "_gain", "_loss", "_ag", "_al")


def atr(df, keys, n: int = 14, out: str = "atr", block=None) -> DataFrame:
    """Wilder mean (adjusted EWM, α=1/n, min_periods=n) of the true range."""
    return compute(df, keys, [("atr", out, n)], block=block)


def adx(df, keys, n: int = 14, prefix: str = "", block=None) -> DataFrame:
    """F8: ADX, DMP, DMN with Wilder means; ATR from :func:`atr`'s definition."""
    return compute(df, keys, [("adx", prefix, n)], block=block)


def macd(df, keys, fast: int = 12, slow: int = 26, signal: int = 9, x: str = "close",
         prefix: str = "", block=None) -> DataFrame:
    """line = EMA(fast) - EMA(slow); signal = seeded EMA of the line from its
    first defined bar; histogram = line - signal (on ``close``)."""
    if x != "close":
        raise ValueError("macd is defined on the close column")
    return compute(df, keys, [("macd", prefix, fast, slow, signal)], block=block)


def cross_flags(above: Column, prev_above: Column) -> tuple[Column, Column]:
    """F10 boolean-lag flavour: warm-up counts as 'not above'; the first row never fires."""
    up = above & (prev_above == F.lit(False))
    down = (~above) & (prev_above == F.lit(True))
    return F.coalesce(up, F.lit(False)), F.coalesce(down, F.lit(False))


def hold_last(signal: str) -> tuple[Last, Column]:
    """E11 scan part: replace 0 by null and carry the last non-zero value."""
    return Last(), F.nullif(F.col(signal), F.lit(0))


# --------------------------------------------------------------------------
# fused computation: one rolling pass + one scan per dependency level
# --------------------------------------------------------------------------

def compute(df: DataFrame, keys: Sequence[str], specs: Sequence[tuple], block=None) -> DataFrame:
    """Compute several indicators with as few passes as their dependencies allow.

    ``specs`` items: ``("ema", out, x, n)``, ``("sma", out, x, n)``,
    ``("rsi", out, n, style)``, ``("atr", out, n)``, ``("adx", prefix, n)``
    (→ ``adx``, ``dmp``, ``dmn``), ``("macd", prefix, fast, slow, signal)``
    (→ ``macd``, ``macd_signal``, ``macd_hist``).  Definitions equal the
    single-indicator functions above; all first-level recurrences share one
    scan, the MACD signal line and ADX smoothing share a second one.
    """
    keys = list(keys)
    specs = list(dict.fromkeys(specs))
    # indicators already present under their canonical names (see precompute)
    # are aliased instead of recomputed
    aliases: dict[str, Column] = {}
    todo = []
    for sp in specs:
        have = _canonical(sp)
        if have and all(c_ in df.columns for c_ in have.values()):
            aliases.update({o: F.col(c_) for o, c_ in have.items()})
        else:
            todo.append(sp)
    if not todo:
        return df.withColumns(aliases)
    specs = todo
    emas: dict[str, tuple[str, int]] = {}
    for s in specs:
        if s[0] == "ema":
            emas[s[1]] = (s[2], s[3])
        elif s[0] == "macd":
            _, p, f, sl, g = s
            emas[f"_m{p}f"] = ("close", f)
            emas[f"_m{p}s"] = ("close", sl)
    smas = [(s[1], s[2], s[3]) for s in specs if s[0] == "sma"]
    need_diff = any(s[0] in ("rsi", "atr", "adx") for s in specs)
    look = max([n - 1 for _, n in emas.values()] + [n - 1 for _, _, n in smas] + [1 if need_diff else 0])

    def st1(w):
        cols = {f"_seed{o}": w_mean(x, n, w) for o, (x, n) in emas.items()}
        cols.update({o: w_mean(x, n, w) for o, x, n in smas})
        if need_diff:
            cols.update({"_pc": F.lag("close", 1).over(w), "_ph": F.lag("high", 1).over(w),
                         "_pl": F.lag("low", 1).over(w)})
        return cols
    x = rolling(df, keys, st1, look, block=block) if look > 0 or smas else df
    o_ = F.col(ORD)
    parts: dict = {}
    for o, (src, n) in emas.items():
        a = 2.0 / (n + 1)
        parts[f"_e{o}"] = (Affine(), {"a": F.when(o_ < n, F.lit(0.0)).otherwise(F.lit(1.0 - a)),
                                      "b": F.when(o_ < n - 1, F.lit(0.0)).when(o_ == n - 1, F.col(f"_seed{o}"))
                                      .otherwise(F.lit(a) * c(src))})
    ewm1: dict[str, tuple[str, float, int]] = {}
    if need_diff:
        dx_ = F.col("close") - F.col("_pc")
        up, dn = F.col("high") - F.col("_ph"), F.col("_pl") - F.col("low")
        x = x.withColumns({
            "_gain": F.when(dx_.isNull(), None).otherwise(F.greatest(dx_, F.lit(0.0))),
            "_loss": F.when(dx_.isNull(), None).otherwise(F.greatest(-dx_, F.lit(0.0))),
            "_tr": F.when(F.col("_pc").isNull(), None).otherwise(F.greatest(
                F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_pc")), F.abs(F.col("_pc") - F.col("low")))),
            "_pdm": F.when(up.isNull() | dn.isNull(), None).otherwise(F.when((up > dn) & (up > 0), up).otherwise(F.lit(0.0))),
            "_ndm": F.when(up.isNull() | dn.isNull(), None).otherwise(F.when((dn > up) & (dn > 0), dn).otherwise(F.lit(0.0)))})
    for s in specs:
        if s[0] == "rsi":
            n = s[2]
            ewm1[f"_g{n}"] = ("_gain", 1.0 / n, n)
            ewm1[f"_l{n}"] = ("_loss", 1.0 / n, n)
        elif s[0] in ("atr", "adx"):
            n = s[2]
            ewm1[f"_t{n}"] = ("_tr", 1.0 / n, n)
            if s[0] == "adx":
                ewm1[f"_p{n}"] = ("_pdm", 1.0 / n, n)
                ewm1[f"_n{n}"] = ("_ndm", 1.0 / n, n)

    def add_ewm(parts, spec):
        for o, (src, alpha, _) in spec.items():
            valid = c(src).isNotNull()
            parts[f"{o}N"] = (Affine(), {"a": F.lit(1.0 - alpha), "b": F.coalesce(c(src), F.lit(0.0))})
            parts[f"{o}D"] = (Affine(), {"a": F.lit(1.0 - alpha), "b": F.when(valid, 1.0).otherwise(0.0)})
            parts[f"{o}K"] = (Sum(), F.when(valid, 1).otherwise(0))

    def ewm_val(o, mp):
        return F.when(F.col(f"{o}K") >= mp, F.col(f"{o}N_b") / F.col(f"{o}D_b"))

    add_ewm(parts, ewm1)
    if parts:
        x = scan(x, keys, parts, block=block)
    drop = [f"_seed{o}" for o in emas] + [f"_e{o}_{f}" for o in emas for f in ("a", "b")]
    drop += [f"{o}{p}" for o in ewm1 for p in ("N_a", "N_b", "D_a", "D_b", "K")]
    drop += ["_pc", "_ph", "_pl", "_gain", "_loss", "_tr", "_pdm", "_ndm"]
    cols = {}
    for o, (_, n) in emas.items():
        cols[o] = F.when(o_ >= n - 1, F.col(f"_e{o}_b"))
    for s in specs:
        if s[0] == "rsi":
            _, out, n, style = s
            g, l_ = ewm_val(f"_g{n}", n), ewm_val(f"_l{n}", n)
            cols[out] = (F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + F.try_divide(g, F.nullif(l_, F.lit(0.0))))
                         if style == "ratio" else F.lit(100.0) * F.try_divide(g, g + l_))
        elif s[0] == "atr":
            cols[s[1]] = ewm_val(f"_t{s[2]}", s[2])
        elif s[0] == "adx":
            p, n = s[1], s[2]
            k = F.try_divide(F.lit(100.0), ewm_val(f"_t{n}", n))
            cols[f"{p}dmp"] = k * ewm_val(f"_p{n}", n)
            cols[f"{p}dmn"] = k * ewm_val(f"_n{n}", n)
    x = x.withColumns(cols)
    # second level: MACD signal line and ADX smoothing
    parts2: dict = {}
    macds = [s for s in specs if s[0] == "macd"]
    adxs = [s for s in specs if s[0] == "adx"]
    post = {}
    for _, p, f, sl, g in macds:
        x = x.withColumn(f"{p}macd", F.col(f"_m{p}f") - F.col(f"_m{p}s"))
    if macds:
        gmax = max(g for *_, g in macds)
        x = rolling(x, keys, lambda w: {f"_ms{p}": w_mean(f"{p}macd", g, w) for _, p, f, sl, g in macds},
                    gmax - 1, block=block)
        for _, p, f, sl, g in macds:
            first = max(f, sl) - 1 + g - 1
            a = 2.0 / (g + 1)
            parts2[f"_sig{p}"] = (Affine(), {
                "a": F.when(o_ <= first, F.lit(0.0)).otherwise(F.lit(1.0 - a)),
                "b": F.when(o_ < first, F.lit(0.0)).when(o_ == first, F.col(f"_ms{p}"))
                .otherwise(F.lit(a) * F.col(f"{p}macd"))})
            post[f"{p}macd_signal"] = F.when(o_ >= first, F.col(f"_sig{p}_b"))
            drop += [f"_m{p}f", f"_m{p}s", f"_ms{p}", f"_sig{p}_a", f"_sig{p}_b"]
    ewm2 = {}
    for _, p, n in adxs:
        x = x.withColumn(f"_dx{p}{n}", F.lit(100.0) * F.try_divide(
            F.abs(F.col(f"{p}dmp") - F.col(f"{p}dmn")), F.col(f"{p}dmp") + F.col(f"{p}dmn")))
        ewm2[f"_x{p}{n}"] = (f"_dx{p}{n}", 1.0 / n, n)
        post[f"{p}adx"] = ewm_val(f"_x{p}{n}", n)
        drop += [f"_dx{p}{n}"] + [f"_x{p}{n}{q}" for q in ("N_a", "N_b", "D_a", "D_b", "K")]
    add_ewm(parts2, ewm2)
    if parts2:
        x = scan(x, keys, parts2, block=block)
        x = x.withColumns(post)
        for _, p, *_ in macds:
            x = x.withColumn(f"{p}macd_hist", F.col(f"{p}macd") - F.col(f"{p}macd_signal"))
    x = x.drop(*[d for d in drop if d in x.columns])
    return x.withColumns(aliases) if aliases else x


def _canonical(spec: tuple) -> dict[str, str]:
    """Output column → canonical column name of an indicator spec."""
    kind = spec[0]
    if kind == "ema":
        return {spec[1]: f"__ema_{spec[2]}_{spec[3]}"}
    if kind == "sma":
        return {spec[1]: f"__sma_{spec[2]}_{spec[3]}"}
    if kind == "rsi":
        return {spec[1]: f"__rsi_{spec[2]}_{spec[3]}"}
    if kind == "atr":
        return {spec[1]: f"__atr_{spec[2]}"}
    if kind == "adx":
        p, n = spec[1], spec[2]
        return {f"{p}{c}": f"__a{n}_{c}" for c in ("adx", "dmp", "dmn")}
    if kind == "macd":
        p, f, sl, g = spec[1:]
        return {f"{p}{c}": f"__m{f}_{sl}_{g}_{c}" for c in ("macd", "macd_signal", "macd_hist")}
    return {}


def precompute(df: DataFrame, keys: Sequence[str], specs: Sequence[tuple], block=None) -> DataFrame:
    """Compute indicators under canonical names so that later :func:`compute`
    calls (e.g. inside several signal generators) reuse them."""
    canon = []
    for sp in specs:
        kind = sp[0]
        if kind == "adx":
            canon.append(("adx", f"__a{sp[2]}_", sp[2]))
        elif kind == "macd":
            canon.append(("macd", f"__m{sp[2]}_{sp[3]}_{sp[4]}_", *sp[2:]))
        else:
            canon.append((kind, _canonical(sp)[sp[1]], *sp[2:]))
    return compute(df, keys, canon, block=block)
