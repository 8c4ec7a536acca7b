"""Table maintenance as DataFrame jobs.

Upserts are "new ∪ (old anti-join new)" on the key, written with dynamic
partition overwrite when a path is given; every function returns the
resulting DataFrame so it can be checked before it is written.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_bars(df: DataFrame) -> DataFrame:
    """Drop rows with a missing O/H/L/C; keep ``high >= low and open > 0``."""
    return df.dropna(subset=["open", "high", "low", "close"]).where(
        (F.col("high") >= F.col("low")) & (F.col("open") > 0))


def drop_zero_volume(df: DataFrame) -> DataFrame:
    """When a volume column exists (any case) drop rows with volume 0,
    then keep the OHLC columns (and the keys in front of them)."""
    vol = next((c for c in df.columns if c.lower() == "volume"), None)
    x = df.where(F.col(vol) != 0) if vol else df
    keep = [c for c in x.columns if c.lower() not in ("volume",)]
    return x.select(*keep)


def merge_bars(frames: Sequence[DataFrame], keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Concatenate sources and keep the *last* source's row per key
    (explicit source order instead of sort stability)."""
    keys = list(keys)
    u = None
    for i, f in enumerate(frames):
        x = f.withColumn("_src", F.lit(i))
        u = x if u is None else u.unionByName(x, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col("_src").desc())
    return u.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r", "_src")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """Insert-or-replace on ``keys``: new rows plus old rows whose key
    is not among the new ones.  Of new rows with one key the last by ``order``
    stays (without an order, any one of them)."""
    keys = list(keys)
    if order is not None:
        w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc_nulls_last() for o in order])
        new = new.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    else:
        new = new.dropDuplicates(keys)
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"),
                           allowMissingColumns=True)


def write_upsert(result: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Write an upsert result over the partitions that occur in it.  ``path`` must
    not be a path that ``result`` reads."""
    (result.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(path))


def evolve_schema(df: DataFrame, add: dict[str, tuple[str, object]]) -> DataFrame:
    """Add missing columns ``{name: (type, default)}`` for old rows."""
    x = df
    for name, (typ, default) in add.items():
        if name not in x.columns:
            x = x.withColumn(name, F.lit(default).cast(typ))
    return x


def count_where(df: DataFrame, cond: Column | None = None) -> DataFrame:
    """Filtered count as a one-row frame."""
    x = df.where(cond) if cond is not None else df
    return x.agg(F.count(F.lit(1)).alias("n"))


KEYS_PER_TASK = 1_000_000  # keys that one task counts at a time in a large table


def check_constraints(df: DataFrame, name: str, pk: Sequence[str] = (), not_null: Sequence[str] = (),
                      unique: Sequence[Sequence[str]] = (),
                      fks: Sequence[tuple[Sequence[str], DataFrame, Sequence[str]]] = ()) -> DataFrame:
    """Violation report ``(table, constraint, kind, key, n_rows)``:
    duplicate primary / unique keys, nulls in NOT NULL columns, and foreign
    keys without a parent (anti join)."""
    parts = []
    tasks_for = lambda x: -(-x.count() // KEYS_PER_TASK)
    tasks = tasks_for(df) if pk or unique or fks else 1

    def dup(cols, kind):
        cols = list(cols)
        # nearly all keys occur once, so counting before the exchange saves nothing, and adaptive
        # execution would join the partitions behind it to one per core, whatever their size
        keys = df.select(*cols) if tasks == 1 else df.select(*cols).repartition(tasks, *cols)
        g = keys.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)
        return g.select(F.lit(name).alias("table"), F.lit(",".join(cols)).alias("constraint"),
                        F.lit(kind).alias("kind"),
                        F.concat_ws("|", *[F.col(c).cast("string") for c in cols]).alias("key"), "n_rows")

    if pk:
        parts.append(dup(pk, "primary_key"))
    for u in unique:
        parts.append(dup(u, "unique"))
    checked = list(dict.fromkeys([*not_null, *pk]))
    if checked:     # all null counts in one pass
        nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in checked])
        each = nulls.select(F.explode(F.array(*[F.struct(F.lit(c).alias("constraint"), F.col(c).alias("n_rows"))
                                                for c in checked])).alias("e")).where("e.n_rows > 0")
        parts.append(each.select(F.lit(name).alias("table"), "e.constraint", F.lit("not_null").alias("kind"),
                                 F.lit(None).cast("string").alias("key"), "e.n_rows"))
    for cols, parent, pcols in fks:
        cols, pcols = list(cols), list(pcols)
        p = parent.select(*[F.col(pc).alias(c) for pc, c in zip(pcols, cols)])
        whole = reduce(and_, [F.col(c).isNotNull() for c in cols])   # a null column: no reference is made
        child = df.where(whole)
        if tasks > 1 and tasks_for(parent) > 1:     # both large: a task sorts a bounded share of either
            child, p = child.select(*cols).repartition(tasks, *cols), p.repartition(tasks, *cols)
        orphans = child.join(p.distinct(), cols, "left_anti")
        g = orphans.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_rows"))
        parts.append(g.select(F.lit(name).alias("table"), F.lit(",".join(cols)).alias("constraint"),
                              F.lit("foreign_key").alias("kind"),
                              F.concat_ws("|", *[F.col(c).cast("string") for c in cols]).alias("key"),
                              "n_rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def add_knowledge_pages(old: DataFrame, new: DataFrame, now: Column, force: bool = False) -> DataFrame:
    """Add or refresh pages by URL.  Existing URLs keep their id and
    ``added_at`` and get a new ``last_fetched``; without ``force`` they are
    reported ``already_exists`` and left unchanged.  Status per URL:
    added / updated / already_exists / kept."""
    o = old.alias("o")
    n = new.alias("n")
    j = o.join(n, F.col("o.url") == F.col("n.url"), "full_outer")
    in_o, in_n = F.col("o.url").isNotNull(), F.col("n.url").isNotNull()
    status = (F.when(in_n & ~in_o, F.lit("added"))
              .when(in_n & in_o, F.lit("updated" if force else "already_exists"))
              .otherwise(F.lit("kept")))
    take_new = in_n & (~in_o | F.lit(force))
    return j.select(
        F.coalesce(F.col("o.id"), F.col("n.id")).alias("id"),
        F.coalesce(F.col("o.url"), F.col("n.url")).alias("url"),
        F.when(take_new, F.col("n.title")).otherwise(F.col("o.title")).alias("title"),
        F.when(take_new, F.col("n.content")).otherwise(F.col("o.content")).alias("content"),
        F.coalesce(F.col("o.added_at"), now).alias("added_at"),
        F.when(take_new, now).otherwise(F.col("o.last_fetched")).alias("last_fetched"),
        status.alias("status"))


def remove_by_key(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Table minus the given keys (anti join)."""
    return df.join(keys, list(on), "left_anti")


def list_knowledge(df: DataFrame) -> DataFrame:
    """Pages with content length, newest first."""
    return df.select("id", "url", "title", F.length("content").alias("content_length"), "added_at") \
        .orderBy(F.col("added_at").desc(), F.col("id"))


def append_metric_run(metrics: DataFrame, path: str) -> None:
    """Append ``(metric_name, value, phase, created_at)`` rows."""
    metrics.select("metric_name", "value", "phase", "created_at").write.mode("append").parquet(path)
