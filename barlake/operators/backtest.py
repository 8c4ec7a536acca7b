"""Signals → positions → trades → equity.

The reference runs a per-bar loop.  Here the same ledger is two prefix scans:

* position = last non-zero signal (H1: an opposite signal closes and reverses
  on the same bar; the position never goes flat);
* with ``changed`` = the bar where the position takes a new value, the cash
  ledger is ``capital + point_value·Σ pos[t-1]·(close[t]-close[t-1])
  - fee·(#entries) - 2·fee·(#closes)``.  The mark-to-market sum telescopes to
  ``(exit-entry)·side`` per trade, so this equals the loop's cash + unrealised
  value (including its 3-fees-per-round-trip quirk, ``fees='parity'``).

Fill price is the bar close (``fill='close'``), as in the reference loop.
:func:`backtest_open` settles orders at opens and knows a forced exit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.operators.sequence import Last, Max, Sum, lag_cols, scan

# Contract defaults (fixed values of the reference configuration)
POINT_VALUE = 200.0
COMMISSION = 100.0
SLIPPAGE_POINTS = 1.0
INIT_CASH = 500_000.0


@dataclass(frozen=True)
class Contract:
    point_value: float = POINT_VALUE
    commission: float = COMMISSION
    slippage: float = SLIPPAGE_POINTS
    init_cash: float = INIT_CASH
    fees: str = "parity"  # 'parity': fee at entry + 2 fees at close; 'consistent': 1 + 1

    @property
    def fee(self) -> float:
        return self.commission + self.slippage * self.point_value


def backtest(df: DataFrame, keys: Sequence[str], contract: Contract = Contract(),
             signal: str = "signal", price: str = "close", block: int | None = None) -> DataFrame:
    """Add ``position``, ``trade_pnl`` (on closing bars), ``equity``, ``peak``,
    ``drawdown`` and ``ret`` (bar return of equity) to a signal frame with ``_ord``."""
    keys = list(keys)
    pv, fee = contract.point_value, contract.fee
    close_fee = 2.0 * fee if contract.fees == "parity" else fee
    trade_fee = 2.0 * fee
    x = scan(df, keys, {"position": (Last(), F.nullif(F.col(signal), F.lit(0))),
                        "_px": (Last(), F.col(price))},
             exclusive=["position", "_px"], block=block)
    pos, prev = F.col("position"), F.col("position_prev")
    changed = pos.isNotNull() & (prev.isNull() | (pos != prev))
    closing = changed & prev.isNotNull()
    x = x.withColumns({"_chg": changed, "_cls": closing})
    move = F.coalesce(F.col("position_prev") * (F.col(price) - F.col("_px_prev")), F.lit(0.0))
    x = scan(x, keys, {
        "entry_price": (Last(), F.when(F.col("_chg"), F.col(price))),
        "_ne": (Sum(), F.col("_chg").cast("long")),
        "_nc": (Sum(), F.col("_cls").cast("long")),
        "_mtm": (Sum(), move)},
        exclusive=["entry_price", "_ne", "_nc", "_mtm"], block=block)

    def eq(mtm, ne, nc):
        return (F.lit(contract.init_cash) + F.lit(pv) * mtm - F.lit(fee) * ne - F.lit(close_fee) * nc)

    x = x.withColumns({
        "equity": eq(F.col("_mtm"), F.col("_ne"), F.col("_nc")),
        "_eq_prev": F.when(F.col("_mtm_prev").isNotNull(),
                           eq(F.col("_mtm_prev"), F.col("_ne_prev"), F.col("_nc_prev"))),
        "trade_pnl": F.when(F.col("_cls"), (F.col(price) - F.col("entry_price_prev"))
                            * F.col("position_prev") * F.lit(pv) - F.lit(trade_fee)),
    })
    x = x.withColumn("ret", F.try_divide(F.col("equity"), F.col("_eq_prev")) - F.lit(1.0))
    x = scan(x, keys, {"peak": (Max(), F.col("equity"))}, block=block)
    x = x.withColumn("drawdown", F.try_divide(F.col("equity") - F.col("peak"), F.col("peak")))
    return x.drop("_px", "_px_prev", "_chg", "_cls", "_ne", "_nc", "_mtm", "_ne_prev",
                  "_nc_prev", "_mtm_prev", "_eq_prev")


def backtest_open(df: DataFrame, keys: Sequence[str], contract: Contract = Contract(), signal: str = "signal",
                  exit_marker: str | None = None, ts: str = "ts", block: int | None = None) -> DataFrame:
    """H2 with ``fill='open'`` and H8: what a bar's close decides is a pending order that
    the next bar's open settles.

    ``signal`` is delayed by one bar already (E1), so it is settled at the open of its
    own bar; ``exit_marker`` stands on the bar that decides and is settled one bar later
    as *forced flat*, before any signal of that bar.  The state is -1, 0 or 1: a signal
    enters or reverses, forced flat closes, a bar without an order keeps the position.
    A bar earns the old position from the last close to its open and the new one from
    its open to its close.  Adds ``position``, ``position_prev``, ``fill_price``,
    ``entry_price``/``entry_ts`` (and ``_prev``: before this bar), ``forced``,
    ``trade_pnl`` on closing bars, ``equity``, ``peak``, ``drawdown`` and ``ret``.  An
    order of the last bar is never settled."""
    keys = list(keys)
    pv, fee = contract.point_value, contract.fee
    close_fee = 2.0 * fee if contract.fees == "parity" else fee
    forced = F.lit(False)
    if exit_marker is not None:
        df = lag_cols(df, keys, {"_exit": (exit_marker, 1)}, block)
        forced = F.coalesce(F.col("_exit"), F.lit(False))
    x = df.withColumn("_forced", forced)
    order = F.when(F.col("_forced"), F.lit(0)).otherwise(F.nullif(F.col(signal), F.lit(0)))
    x = scan(x, keys, {"position": (Last(), order)}, block=block)
    x = x.withColumn("position", F.coalesce("position", F.lit(0)))
    x = lag_cols(x, keys, {"position_prev": ("position", 1), "_px_prev": ("close", 1)}, block)
    x = x.withColumn("position_prev", F.coalesce("position_prev", F.lit(0)))
    pos, prev = F.col("position"), F.col("position_prev")
    opening, closing = (pos != prev) & (pos != 0), (pos != prev) & (prev != 0)
    move = F.coalesce(prev * (F.col("open") - F.col("_px_prev")), F.lit(0.0)) + pos * (F.col("close") - F.col("open"))
    x = x.withColumns({"fill_price": F.when(pos != prev, F.col("open")), "forced": closing & F.col("_forced"),
                       "_cls": closing})
    x = scan(x, keys, {
        "entry_price": (Last(), F.when(opening, F.col("open"))),
        "entry_ts": (Last(), F.when(opening, F.col(ts))),
        "_ne": (Sum(), opening.cast("long")), "_nc": (Sum(), closing.cast("long")), "_mtm": (Sum(), move)},
        exclusive=["entry_price", "entry_ts"], block=block)
    x = x.withColumns({
        "equity": F.lit(contract.init_cash) + F.lit(pv) * F.col("_mtm") - F.lit(fee) * F.col("_ne") - F.lit(close_fee) * F.col("_nc"),
        "trade_pnl": F.when(F.col("_cls"), (F.col("open") - F.col("entry_price_prev")) * F.col("position_prev")
                            * F.lit(pv) - F.lit(2.0 * fee))})
    x = lag_cols(x, keys, {"_eq_prev": ("equity", 1)}, block)
    x = x.withColumn("ret", F.try_divide(F.col("equity"), F.col("_eq_prev")) - F.lit(1.0))
    x = scan(x, keys, {"peak": (Max(), F.col("equity"))}, block=block)
    x = x.withColumn("drawdown", F.try_divide(F.col("equity") - F.col("peak"), F.col("peak")))
    return x.drop("_px_prev", "_cls", "_forced", "_exit", "_ne", "_nc", "_mtm", "_eq_prev")


def open_trades(bt: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Closed trades of :func:`backtest_open`: both fills are opens."""
    return bt.where(F.col("trade_pnl").isNotNull()).select(
        *keys, F.col("entry_ts_prev").alias("entry_ts"), F.col(ts).alias("exit_ts"), F.col("position_prev").alias("side"),
        F.col("entry_price_prev").alias("entry_price"), F.col("fill_price").alias("exit_price"),
        F.col("trade_pnl").alias("pnl"), "forced")


def trades(bt: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Closed trades: one row per closing bar (H2)."""
    return bt.where(F.col("trade_pnl").isNotNull()).select(
        *keys, F.col(ts).alias("exit_ts"), F.col("position_prev").alias("side"),
        F.col("entry_price_prev").alias("entry_price"), F.col("close").alias("exit_price"),
        F.col("trade_pnl").alias("pnl"), "_ord")


def flat_slippage_pnl(entry, exit_, direction, points: float = 4.0, point_value: float = 200.0):
    """H4: (exit - entry)·direction - slippage points, in currency."""
    return ((exit_ - entry) * direction - F.lit(points)) * F.lit(point_value)


def align_signals(bars: DataFrame, signals: DataFrame, keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Signals joined to their bars on the (unique) key."""
    return bars.join(signals, list(keys), "inner")


def apply_rules_and_force_close(df: DataFrame, session_class: str, signal: str = "signal",
                                ts: str = "ts") -> DataFrame:
    """H8: entries only inside the class's opening window; the force-close bar
    carries a separate ``exit_marker`` (the exit fills at the next bar's open),
    so −1 keeps meaning 'short'."""
    from barlake.operators.sessions import apply_session_rules
    return apply_session_rules(df, session_class, signal, ts)
