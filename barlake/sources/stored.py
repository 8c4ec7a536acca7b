"""Partitioned tables in storage: upsert of touched partitions, pruned reads, rejects
(A10–A13, B1).

A table is a Parquet folder with one partition column that is a function of the key.
An upsert reads and rewrites the partitions that occur in its batch and no others: Spark
writes them beside the table and swaps them in when the job commits (dynamic partition
overwrite).  The list of touched partition values is the only thing on the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.session import ensure_checkpoint_dir, materialize
from barlake.sources import tables as tb

Check = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def new_table(spark: SparkSession, name: str) -> str:
    """A fresh table path in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_table(df: DataFrame, path: str, partition: str) -> None:
    """Write (or replace the occurring partitions of) a table.  Rows are rebalanced by
    partition, so a large partition is split over tasks and small ones share files."""
    df.hint("rebalance", F.col(partition)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(partition).parquet(path)


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def partition_files(spark: SparkSession, path: str, schema, partition: str) -> DataFrame:
    """(partition, files): how the table lies in storage, as a written snapshot."""
    files = read_table(spark, path, schema).select(partition, F.col("_metadata.file_path").alias("file")) if exists(spark, path) \
        else spark.createDataFrame([], schema).select(partition, F.lit("").alias("file"))
    return materialize(files.distinct().groupBy(partition).agg(F.array_sort(F.collect_list("file")).alias("files")))


def stored_upsert(batch: DataFrame, path: str, keys: Sequence[str], partition: str, order: Sequence[str] = (),
                  check: Check | None = None, rejects: str | None = None) -> DataFrame:
    """Insert-or-replace a batch into a stored table.  Of equal keys the last by
    ``order`` stays (the order columns themselves are not stored).  Rows that fail
    ``check`` are appended to the table at ``rejects``, with a reason.  Returns the
    batch rows that are now in the table."""
    spark = batch.sparkSession
    good, bad = check(batch) if check else (batch, None)
    if bad is not None and rejects is not None:
        bad.write.mode("append").parquet(rejects)
    empty = good.limit(0)
    new = materialize(tb.upsert(empty, good, keys, order or None).drop(*order))
    touched = [r[0] for r in new.select(partition).distinct().collect()]
    here = F.col(partition).isin([t for t in touched if t is not None])
    if None in touched:
        here = F.coalesce(here, F.lit(False)) | F.col(partition).isNull()
    old = read_table(spark, path, new.schema).where(here)
    write_table(tb.upsert(old, new, keys), path, partition)
    return new


def clear_table(spark: SparkSession, path: str, schema, partition: str, where: Column | None = None) -> int:
    """Remove the rows that match (all without a condition); partitions without such
    rows stay as they are, and so does the schema.  Returns the number removed."""
    rows = read_table(spark, path, schema)
    gone = rows if where is None else rows.where(where)
    counts = gone.groupBy(partition).agg(F.count(F.lit(1)).alias("n")).collect()
    if where is not None and counts:
        values = [r[partition] for r in counts if r[partition] is not None]
        here = F.coalesce(F.col(partition).isin(values), F.lit(False))
        if any(r[partition] is None for r in counts):
            here = here | F.col(partition).isNull()
        left = materialize(rows.where(here).where(~F.coalesce(where, F.lit(False))))
        still = {r[0] for r in left.select(partition).distinct().collect()}
        write_table(left, path, partition)
        emptied = [r[partition] for r in counts if r[partition] not in still]
    else:
        emptied = [r[partition] for r in counts]
    for value in emptied:        # a partition without rows is a folder without files
        name = "__HIVE_DEFAULT_PARTITION__" if value is None else str(value)
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{partition}={name}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return sum(r["n"] for r in counts)


def valid_bars(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The A7 rule with a reason for each bar that fails it."""
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    reason = F.when(F.greatest(*[p.isNull().cast("int") for p in prices]) == 1, "missing price") \
        .when(F.col("high") < F.col("low"), "high below low").when(F.col("open") <= 0, "open not positive")
    x = bars.withColumn("reject_reason", reason)
    return x.where("reject_reason IS NULL").drop("reject_reason"), x.where("reject_reason IS NOT NULL")


# --------------------------------------------------------------------------
# the stored minute table
# --------------------------------------------------------------------------

MONTH = "trading_day_month"


def write_minute_table(bars: DataFrame, path: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bars with trading day and session, stored by month of the trading day."""
    from barlake.sources.bars_csv import build_minute_table
    table = build_minute_table(bars, keys)
    write_table(table, path, MONTH)
    return read_table(bars.sparkSession, path, table.schema)


def trading_days_between(table: DataFrame, start: str, end: str, symbol: str | None = None) -> DataFrame:
    """B1 on the stored table: an inclusive range of trading days.  The months of the
    range are a partition filter, so other months are not listed or read."""
    x = table.where(F.col(MONTH).between(start[:7], end[:7])).where(
        F.col("trading_day").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    return x if symbol is None else x.where(F.col("symbol") == symbol)
