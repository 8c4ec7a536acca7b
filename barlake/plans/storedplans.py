"""Named plans over stored tables: upserts, rejects, pruned reads, maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.operators import retrieval as rv
from barlake.plans.common import round_doubles
from barlake.sources import fixtures as fx
from barlake.sources import stored as st
from barlake.sources import tables as tb

OHLC = ["open", "high", "low", "close"]


def _deliveries(spark, sf_dir):
    """Bars of 2000 on as delivered again, once per order status, so most days come more
    than once; a delivery without a high price is not a bar."""
    o = fx.table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    return o.groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"),
                     F.col("o_orderstatus").alias("delivery")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max(F.when(F.col("o_custkey") % 5 != 0, F.col("o_totalprice"))).alias("high"),
        F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close")) \
        .withColumn("year", F.year("ts"))


def _upserted(spark, sf_dir):
    """The stored daily bars after the deliveries: (path, schema, files before, rejects)."""
    bars = fx.day_bars(spark, sf_dir).withColumn("year", F.year("ts"))
    path = st.new_table(spark, "bars")
    st.write_table(bars, path, "year")
    before = st.partition_files(spark, path, bars.schema, "year")
    st.stored_upsert(_deliveries(spark, sf_dir), path, ["symbol", "ts"], "year", ["delivery"], st.valid_bars, f"{path}-rejects")
    return path, bars.schema, before, f"{path}-rejects"


def stored_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: the stored bars after an upsert with equal keys and bad rows in its batch."""
    path, schema, _, _ = _upserted(spark, sf_dir)
    return round_doubles(st.read_table(spark, path, schema))


def stored_upsert_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: per partition the bars, the rejected rows, and whether its files changed."""
    path, schema, before, rejects = _upserted(spark, sf_dir)
    after = st.partition_files(spark, path, schema, "year").withColumnRenamed("files", "now")
    bad = spark.read.parquet(rejects).groupBy("year").agg(F.count(F.lit(1)).alias("n_rejected"))
    n = st.read_table(spark, path, schema).groupBy("year").agg(F.count(F.lit(1)).alias("n_bars"))
    out = n.join(after, "year").join(before, "year", "left").join(bad, "year", "left")
    return out.select("year", "n_bars", F.coalesce("n_rejected", F.lit(0)).cast("long").alias("n_rejected"),
                      (~F.col("files").eqNullSafe(F.col("now"))).alias("rewritten"))


def minute_table_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11 + B1: the minute table written by month and read by trading day."""
    table = st.write_minute_table(fx.minute_bars(spark, sf_dir), st.new_table(spark, "minutes"))
    rows = st.trading_days_between(table, "2024-01-25", "2024-02-05", "click")
    return round_doubles(rows.select("symbol", "ts", *OHLC, "trading_day", "session_type"))


def _reembedded(spark, sf_dir, dim: int):
    """A re-embedding batch whose every seventh vector is too short."""
    d = fx.developed_fx(spark, sf_dir).where(F.col("logic_type") == 9)
    vec = F.when(F.col("id") % 7 == 0, F.slice("metadata_vector", 1, dim // 2)).otherwise(F.col("metadata_vector"))
    return d.select("id", "logic_type", vec.alias("vec"), F.pmod("id", F.lit(16)).cast("int").alias("shard"))


def _stored_collection(spark, sf_dir, dim: int):
    d = fx.developed_fx(spark, sf_dir).select("id", "logic_type", F.col("semantic_vector").alias("vec"),
                                              F.pmod("id", F.lit(16)).cast("int").alias("shard"))
    path = st.new_table(spark, "collection")
    st.write_table(d, path, "shard")
    st.stored_upsert(_reembedded(spark, sf_dir, dim), path, ["id"], "shard", check=lambda x: rv.check_dim(x, "vec", dim),
                     rejects=f"{path}-rejects")
    return path, d.schema


def collection_rejects(spark: SparkSession, sf_dir: str, dim: int = 64) -> DataFrame:
    """The rows of a re-embedding batch that the dimension check turned away, and
    the first component that the stored row kept."""
    path, schema = _stored_collection(spark, sf_dir, dim)
    kept = st.read_table(spark, path, schema).select("id", F.size("vec").alias("stored_dim"),
                                                     F.col("vec")[0].cast("double").alias("first_component"))
    return round_doubles(spark.read.parquet(f"{path}-rejects").select("id", "reject_reason").join(kept, "id"))


def collection_counts(spark: SparkSession, sf_dir: str, dim: int = 64) -> DataFrame:
    """Filtered counts of the stored collection, before and after it is cleared of
    one logic type and then of everything."""
    path, schema = _stored_collection(spark, sf_dir, dim)

    def counts(step: str) -> DataFrame:
        rows = st.read_table(spark, path, schema)
        named = [("all", None), ("logic_type = 3", F.col("logic_type") == 3), ("logic_type < 5", F.col("logic_type") < 5)]
        out = None
        for name, cond in named:
            one = tb.count_where(rows, cond).select(F.lit(step).alias("step"), F.lit(name).alias("filter"), "n")
            out = one if out is None else out.unionByName(one)
        return st.materialize(out)

    before = counts("stored")
    st.clear_table(spark, path, schema, "shard", F.col("logic_type") == 3)
    partly = counts("type 3 cleared")
    st.clear_table(spark, path, schema, "shard")
    return before.unionByName(partly).unionByName(counts("cleared"))
