"""Shared helpers for the named query plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Currency amounts built from long sums (equity, average trade PnL) are
# reported in cents: their summation order differs across engines by ~1e-6.
MONEY = ("final_equity", "avg_win", "avg_loss")


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (results are compared after rounding: float
    sums are order-dependent across engines); money columns to cents."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            d = min(digits, 2) if f.name in MONEY else digits
            cols.append(F.round(F.col(f.name), d).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
