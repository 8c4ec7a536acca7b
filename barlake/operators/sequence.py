"""Keyed, ordered sequences processed in bounded blocks.

Every time-series operator of the library (lags, rolling windows, running
peaks, forward fills, EMA-type recurrences, the RSI state machine, the
back-tester's cash ledger) is one of three shapes:

* **bounded look-back / look-ahead** (``lag``, ``lead``, rolling n):
  :func:`rolling`.  Rows are numbered per key (:func:`sequence`), cut
  into blocks of ``block`` rows, and each row is copied into the neighbouring
  block(s) that need it as a halo.  A window then runs per ``(key, block)``.
* **prefix scans over an associative operator** (sum, max, last non-null,
  affine maps ``y = a*y_prev + b``, finite-state transitions): :func:`scan`.
  Inside a block the scan is a native running window (sum/max/min/last) or a
  vectorised numpy doubling over the block (affine/automaton).  Block totals form a
  much smaller sequence that is scanned the same way (recursively) and joined
  back as a carry.
* **per-key aggregates**: ordinary ``groupBy`` (partial aggregation).

No step puts a whole key into one task: a task holds at most one block (plus
halo) of one key.  :func:`sequence` measures the longest key once and picks
the number of carry levels (65 536-row blocks: one level up to 4.3e9 rows per
key, two up to 2.8e14); a key longer than the chosen blocking makes the top
level raise rather than return a wrong answer.  Block-local folds of the
affine/automaton scans run as one grouped pandas step per block, composing
the maps by doubling in numpy (no per-row Python); with ``LOCAL_SCAN =
"windows"`` the same doubling runs as log2(block) lag window passes on the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORD = "_ord"
DEFAULT_BLOCK = 1 << 16
DEFAULT_DEPTH = 3

ColMap = dict[str, Column]


@dataclass(frozen=True)
class Blocking:
    """How a keyed sequence is cut: ``block`` rows per task-level group and
    ``depth`` carry levels (``block**(depth+1)`` rows per key at most).
    ``max_len`` is a known upper bound of rows per key, if any."""

    block: int = DEFAULT_BLOCK
    depth: int = DEFAULT_DEPTH
    max_len: int | None = None

    def rows_at(self, level: int) -> int:
        """Upper bound of rows per key at carry level ``level``."""
        if self.max_len is None:
            return self.block
        n = self.max_len
        for _ in range(level):
            n = -(-n // self.block)
        return max(1, min(n, self.block))


def plan_blocking(max_len: int, block: int = DEFAULT_BLOCK) -> Blocking:
    depth, cap = 0, block
    while cap < max_len:
        cap *= block
        depth += 1
    return Blocking(block, depth, max_len)


def as_blocking(block: int | Blocking | None) -> Blocking:
    if isinstance(block, Blocking):
        return block
    return Blocking(int(block or DEFAULT_BLOCK), DEFAULT_DEPTH, None)


# --------------------------------------------------------------------------
# ordinals
# --------------------------------------------------------------------------

def sequence(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
             bucket: Column | None = None, block: int = DEFAULT_BLOCK,
             max_len: int | None = None, ranged: bool = False) -> tuple[DataFrame, Blocking]:
    """Number rows per key (``_ord``) and choose the blocking.

    The longest key is measured with one aggregate over the key columns
    (unless ``max_len`` is given).  Keys that fit one block are numbered with a
    plain per-key ``row_number``; longer ones with :func:`with_ordinal`, whose
    numbering groups are key × bucket, or with ``ranged`` by :func:`ranged_ordinal`,
    for keys of which a single bucket may hold a large share of the table.
    """
    keys = list(keys)
    if max_len is None:
        max_len = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    bl = plan_blocking(max(int(max_len), 1), block)
    if bl.depth == 0:
        order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
        w = Window.partitionBy(*keys).orderBy(*order_cols)
        return df.withColumn(ORD, (F.row_number().over(w) - F.lit(1)).cast("long")), bl
    return (ranged_ordinal(df, keys, order) if ranged else with_ordinal(df, keys, order, bucket)), bl


#: Tables of key starts up to this many rows are broadcast; larger ones join by shuffle.
BROADCAST_KEYS = 100_000


def ranged_ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], parts: int | None = None) -> DataFrame:
    """Add ``_ord`` without a numbering group: rows are range-partitioned by (keys,
    order) at sampled boundaries, so a key, and a single hour of it, spreads over as many
    tasks as its share of the rows; rows are then numbered through by their place in
    the sorted partitions and the number of a key's first row is taken off."""
    from barlake.session import materialize
    keys = list(keys)
    spark = df.sparkSession
    by = [F.col(k).asc_nulls_first() for k in keys] + [(F.col(c) if isinstance(c, str) else c).asc_nulls_first() for c in order]
    n = [parts] if parts else []
    placed = materialize(df.repartitionByRange(*n, *by).sortWithinPartitions(*by).withColumn("_pos", F.monotonically_increasing_id()))
    part, place = F.shiftright("_pos", 33), F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1))
    # one row per partition of the written table
    sizes = placed.groupBy(part.alias("_part")).agg((F.max(place) + 1).alias("n")).collect()
    base, bases = 0, []
    for row in sorted(sizes, key=lambda r: r["_part"]):
        bases.append((row["_part"], base))
        base += row["n"]
    x = placed.withColumn("_part", part).join(F.broadcast(spark.createDataFrame(bases, "_part long, _base long")), "_part")
    x = x.withColumn(ORD, F.col("_base") + place).drop("_part", "_base", "_pos")
    starts = materialize(x.groupBy(*keys).agg(F.min(ORD).alias("_first")))
    small = F.broadcast(starts) if starts.count() <= BROADCAST_KEYS else starts
    return null_safe_join(x, small, keys, "inner").withColumn(ORD, (F.col(ORD) - F.col("_first")).cast("long")).drop("_first")


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which null keys match each other, as they do in a window's
    partitions; the right side's keys are dropped."""
    named = right.select(*[F.col(c).alias(f"_on_{c}") for c in on], *[c for c in right.columns if c not in on])
    cond = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    return left.join(named, cond, how).drop(*[f"_on_{c}" for c in on])


def with_ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                 bucket: Column | None = None) -> DataFrame:
    """Add ``_ord`` for keys of any length.

    Rows are numbered inside ``(key, bucket)`` groups, and each bucket is offset
    by the row count of earlier buckets of the key.  ``bucket`` must be
    monotone in ``order`` (default: the calendar day of the first order
    column), so a numbering group is one key-day, and the offset table has one
    row per key-bucket (calendar-bounded, not data-bounded).
    """
    keys = list(keys)
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    if bucket is None:
        bucket = F.to_date(order_cols[0])
    b = df.withColumn("_bkt", bucket)
    w = Window.partitionBy(*keys, "_bkt").orderBy(*order_cols)
    b = b.withColumn("_rn", F.row_number().over(w) - F.lit(1))
    counts = b.groupBy(*keys, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    wc = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*keys, "_bkt", F.coalesce(F.sum("_n").over(wc), F.lit(0)).alias("_off"))
    out = null_safe_join(b, offs, [*keys, "_bkt"], "inner")
    return out.withColumn(ORD, (F.col("_off") + F.col("_rn")).cast("long")).drop("_bkt", "_rn", "_off")


# --------------------------------------------------------------------------
# bounded windows with halos
# --------------------------------------------------------------------------

Stage = Callable[[Window], ColMap]


def rolling(df: DataFrame, keys: Sequence[str], stages: Stage | Sequence[Stage],
            lookback: int, lookahead: int = 0, block: int | Blocking | None = None) -> DataFrame:
    """Evaluate window expressions whose frames reach at most ``lookback`` rows
    back and ``lookahead`` rows ahead (summed over all stages).

    ``stages`` are callables ``w -> {name: Column}`` using the window spec
    ``w`` (partitioned by key and block, ordered by ``_ord``); later stages may
    use columns made by earlier ones.  Results equal an unblocked per-key
    window as long as the declared reach covers every frame.
    """
    keys = list(keys)
    bl = as_blocking(block)
    if callable(stages):
        stages = [stages]
    if bl.depth == 0 and bl.max_len is not None:
        # every key fits one block: a plain per-key window
        w = Window.partitionBy(*keys).orderBy(ORD)
        x = df
        for st in stages:
            x = x.withColumns(st(w))
        return x
    block = bl.block   # a reach longer than a block copies a row into several blocks
    o = F.col(ORD)
    lo = F.greatest(F.floor((o - F.lit(lookahead)) / F.lit(block)), F.lit(0)).cast("long")
    hi = F.floor((o + F.lit(lookback)) / F.lit(block)).cast("long")
    x = df.withColumn("_tb", F.explode(F.sequence(lo, hi)))
    w = Window.partitionBy(*keys, "_tb").orderBy(ORD)
    for st in stages:
        x = x.withColumns(st(w))
    native = F.col("_tb") == F.floor(o / F.lit(block)).cast("long")
    return x.where(native).drop("_tb")


def lag_cols(df: DataFrame, keys: Sequence[str], spec: dict[str, tuple[str, int]],
             block: int | None = None) -> DataFrame:
    """``{out: (col, n)}`` → ``lag(col, n)`` (negative n = lead)."""
    back = max([n for _, n in spec.values()] + [0])
    ahead = max([-n for _, n in spec.values()] + [0])
    return rolling(df, keys, lambda w: {o: F.lag(c, n).over(w) for o, (c, n) in spec.items()},
                   back, ahead, block)


# --------------------------------------------------------------------------
# monoid scans
# --------------------------------------------------------------------------

class Monoid:
    """An associative operator over a tuple of fields.

    ``combine(a, b)`` gets two ``{field: Column}`` maps, ``a`` earlier in the
    sequence and ``b`` later, and returns their composition.  ``native`` names a
    running window function usable inside a block ("sum", "max", "min",
    "last"); otherwise the block-local scan is a doubling over ``lag``.
    """

    fields: tuple[str, ...] = ("v",)
    native: str | None = None

    def combine(self, a: ColMap, b: ColMap) -> ColMap:  # pragma: no cover - interface
        raise NotImplementedError


class Sum(Monoid):
    native = "sum"

    def combine(self, a, b):
        return {"v": a["v"] + b["v"]}

    @staticmethod
    def run(cols):
        v = pd.Series(cols[0])
        if not v.isna().any():
            return [v.cumsum().to_numpy()]
        return [v.fillna(0).cumsum().where(v.notna().cummax()).to_numpy()]


class Max(Monoid):
    native = "max"

    def combine(self, a, b):
        return {"v": F.greatest(a["v"], b["v"])}

    @staticmethod
    def run(cols):
        v = pd.Series(cols[0], dtype="float64")
        return [v.fillna(-np.inf).cummax().where(v.notna().cummax()).to_numpy()]


class Min(Monoid):
    native = "min"

    def combine(self, a, b):
        return {"v": F.least(a["v"], b["v"])}

    @staticmethod
    def run(cols):
        v = pd.Series(cols[0], dtype="float64")
        return [v.fillna(np.inf).cummin().where(v.notna().cummax()).to_numpy()]


class Last(Monoid):
    """Last non-null value (forward fill)."""

    native = "last"

    def combine(self, a, b):
        return {"v": F.coalesce(b["v"], a["v"])}

    @staticmethod
    def run(cols):
        return [pd.Series(cols[0]).ffill().to_numpy()]


class Affine(Monoid):
    """Maps ``y -> a*y + b``; the scan of the maps gives ``y_t`` for any seed."""

    fields = ("a", "b")

    def combine(self, x, y):
        return {"a": y["a"] * x["a"], "b": y["a"] * x["b"] + y["b"]}

    @staticmethod
    def run(cols: list[np.ndarray]) -> list[np.ndarray]:
        """Inclusive prefix composition, vectorised by doubling (log2 n numpy steps)."""
        a = np.asarray(cols[0], dtype=np.float64).copy()
        b = np.asarray(cols[1], dtype=np.float64).copy()
        d = 1
        while d < len(a):
            a_prev, b_prev = a[:-d].copy(), b[:-d].copy()
            b[d:] = a[d:] * b_prev + b[d:]
            a[d:] = a[d:] * a_prev
            d *= 2
        return [a, b]


class Automaton3(Monoid):
    """Transition functions on the states {-1, 0, 1}, stored as their images."""

    fields = ("m0", "m1", "m2")

    def combine(self, x, y):
        def apply(s: Column) -> Column:
            return (F.when(s == -1, y["m0"]).when(s == 0, y["m1"]).otherwise(y["m2"]))
        return {f: apply(x[f]) for f in self.fields}

    @staticmethod
    def run(cols: list[np.ndarray]) -> list[np.ndarray]:
        """Inclusive prefix composition of transition maps, vectorised by doubling."""
        m = np.stack([np.asarray(c_) for c_ in cols], axis=1).astype(np.int64)   # rows × images of (-1, 0, 1)
        d = 1
        while d < len(m):
            prev = m[:-d].copy()
            m[d:] = np.take_along_axis(m[d:], prev + 1, axis=1)   # earlier map first, then this one
            d *= 2
        return [m[:, 0], m[:, 1], m[:, 2]]


def _fname(name: str, m: Monoid, f: str) -> str:
    return name if len(m.fields) == 1 else f"{name}_{f}"


def scan(df: DataFrame, keys: Sequence[str], parts: dict[str, tuple[Monoid, ColMap | Column]],
         exclusive: Iterable[str] = (), block: int | Blocking | None = None,
         checkpoint: bool = True) -> DataFrame:
    """Inclusive prefix scans per key in ``_ord`` order.

    ``parts`` maps an output name to ``(monoid, elements)``; ``elements`` is a
    column (one-field monoids) or ``{field: column}``.  Output columns are
    ``name`` (one field) or ``name_field``.  Names listed in ``exclusive``
    also get ``name_prev`` columns: the scan over strictly earlier rows (null
    on the first row of a key).

    When carries are needed (keys longer than a block) the result is
    checkpointed (reliable checkpoint in ``spark.checkpoint.dir``) so stacked
    scans do not grow the plan.
    """
    keys = list(keys)
    bl = as_blocking(block)
    exclusive = set(exclusive)
    cols: list[tuple[str, Monoid, str]] = []  # (output column, monoid, field)
    elems: ColMap = {}
    for name, (m, el) in parts.items():
        if isinstance(el, Column):
            el = {m.fields[0]: el}
        for f in m.fields:
            c = _fname(name, m, f)
            cols.append((c, m, f))
            elems[c] = el[f]
    x = df.withColumns(elems)
    out = _scan_level(x, keys, parts, cols, exclusive, bl, 0)
    if bl.depth > 0 and checkpoint:
        from barlake.session import materialize
        out = materialize(out)
    return out


def _group_maps(parts):
    out = {}
    for name, (m, _) in parts.items():
        out[name] = (m, {f: F.col(_fname(name, m, f)) for f in m.fields})
    return out


def _local_scan(x: DataFrame, keys, part_col, parts, cols, rows: int) -> DataFrame:
    w = Window.partitionBy(*keys, *([part_col] if part_col else [])).orderBy(ORD)
    native = all(m.native for _, (m, _) in parts.items())
    if native:
        run = w.rowsBetween(Window.unboundedPreceding, 0)
        fn = {"sum": F.sum, "max": F.max, "min": F.min,
              "last": lambda c: F.last(c, ignorenulls=True)}
        return x.withColumns({c: fn[m.native](F.col(c)).over(run) for c, m, _ in cols})
    if LOCAL_SCAN == "pandas" and all(hasattr(m, "run") for _, (m, _) in parts.items()):
        return _pandas_local_scan(x, keys, part_col, parts)
    d = 1
    while d < rows:
        has = F.lag(F.col(ORD), d).over(w).isNotNull()
        new = {}
        for name, (m, cur) in _group_maps(parts).items():
            prev = {f: F.lag(cur[f], d).over(w) for f in m.fields}
            comb = m.combine(prev, cur)
            for f in m.fields:
                new[_fname(name, m, f)] = F.when(has, comb[f]).otherwise(cur[f])
        x = x.withColumns(new)
        d *= 2
    return x


def _pandas_local_scan(x: DataFrame, keys, part_col, parts) -> DataFrame:
    """Block-local scan as one grouped pandas step: each group is one block of
    one key (at most ``block`` rows), scanned with the monoid's vectorised
    ``run``.  One operator instead of log2(block) window passes."""
    groups = [*keys, *([part_col] if part_col else [])]
    spec = [(m, [_fname(name, m, f) for f in m.fields]) for name, (m, _) in parts.items()]
    schema = x.schema

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ORD, kind="stable").reset_index(drop=True)
        for m, names in spec:
            res = m.run([pdf[c].to_numpy() for c in names])
            for c_, v in zip(names, res):
                pdf[c_] = v
        return pdf
    return x.groupBy(*groups).applyInPandas(fn, schema)


# Block-local scans of non-native monoids: "pandas" (one grouped step per
# level) or "windows" (log2(block) lag-doubling passes, JVM only).
LOCAL_SCAN = "pandas"


def _scan_level(x: DataFrame, keys, parts, cols, exclusive, bl: Blocking, level: int) -> DataFrame:
    names = [c for c, _, _ in cols]
    block = bl.block
    rows = bl.rows_at(level)
    if level >= bl.depth:
        x = _local_scan(x, keys, None, parts, cols, rows)
        first = names[0]
        x = x.withColumn(first, F.when(F.col(ORD) >= F.lit(block), F.raise_error(F.lit(
            "sequence longer than the blocking supports; raise depth or block")))
            .otherwise(F.col(first)))
        return _add_exclusive(x, keys, None, parts, exclusive, carry=False)
    x = x.withColumn("_blk", F.floor(F.col(ORD) / F.lit(block)).cast("long"))
    x = _local_scan(x, keys, "_blk", parts, cols, rows)
    # block totals = inclusive value at the last row of each block
    summ = (x.groupBy(*keys, "_blk")
            .agg(F.max_by(F.struct(*names), F.col(ORD)).alias("_s"))
            .select(*keys, F.col("_blk").alias(ORD), *[F.col(f"_s.{c}").alias(c) for c in names]))
    summ = _scan_level(summ, keys, parts, cols, set(), bl, level + 1)
    carry = summ.select(*keys, (F.col(ORD) + F.lit(1)).alias("_blk"),
                        *[F.col(c).alias(f"_c_{c}") for c in names], F.lit(True).alias("_hasc"))
    x = null_safe_join(x, carry, [*keys, "_blk"], "left")
    applied = {}
    for name, (m, cur) in _group_maps(parts).items():
        car = {f: F.col(f"_c_{_fname(name, m, f)}") for f in m.fields}
        comb = m.combine(car, cur)
        for f in m.fields:
            applied[_fname(name, m, f)] = F.when(F.col("_hasc"), comb[f]).otherwise(cur[f])
    x = _add_exclusive(x, keys, "_blk", parts, exclusive, carry=True)
    x = x.withColumns(applied)
    return x.drop("_blk", "_hasc", *[f"_c_{c}" for c in names])


def _add_exclusive(x, keys, part_col, parts, exclusive, carry):
    if not exclusive:
        return x
    w = Window.partitionBy(*keys, *([part_col] if part_col else [])).orderBy(ORD)
    new = {}
    for name, (m, cur) in _group_maps(parts).items():
        if name not in exclusive:
            continue
        prev = {f: F.lag(cur[f], 1).over(w) for f in m.fields}
        first = F.lag(F.col(ORD), 1).over(w).isNull()
        car = {f: F.col(f"_c_{_fname(name, m, f)}") for f in m.fields} if carry else None
        comb = m.combine(car, prev) if carry else None
        for f in m.fields:
            out = f"{_fname(name, m, f)}_prev" if len(m.fields) > 1 else f"{name}_prev"
            if carry:
                new[out] = (F.when(first & F.col("_hasc"), car[f])
                            .when(first, F.lit(None))
                            .when(F.col("_hasc"), comb[f]).otherwise(prev[f]))
            else:
                new[out] = prev[f]
    return x.withColumns(new)
