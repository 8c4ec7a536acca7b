"""Named plans: table maintenance, constraint checks and admission gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.operators import backtest as bt
from barlake.operators import metrics as mt
from barlake.operators import opsanalytics as oa
from barlake.operators import walkforward as wf
from barlake.plans.common import round_doubles
from barlake.sources import fixtures as fx
from barlake.sources import tables as tb


def constraint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16 over the relational tables: keys, not-nulls and foreign keys."""
    t = lambda n: fx.table(spark, sf_dir, n)
    reps = [
        tb.check_constraints(t("region"), "region", pk=["r_regionkey"]),
        tb.check_constraints(t("nation"), "nation", pk=["n_nationkey"],
                             fks=[(["n_regionkey"], t("region"), ["r_regionkey"])]),
        tb.check_constraints(t("customer"), "customer", pk=["c_custkey"], not_null=["c_name"],
                             fks=[(["c_nationkey"], t("nation"), ["n_nationkey"])]),
        tb.check_constraints(t("supplier"), "supplier", pk=["s_suppkey"],
                             fks=[(["s_nationkey"], t("nation"), ["n_nationkey"])]),
        tb.check_constraints(t("orders"), "orders", pk=["o_orderkey"], not_null=["o_orderdate"],
                             fks=[(["o_custkey"], t("customer"), ["c_custkey"])]),
        tb.check_constraints(t("lineitem"), "lineitem", pk=["l_orderkey", "l_linenumber"],
                             fks=[(["l_orderkey"], t("orders"), ["o_orderkey"]),
                                  (["l_partkey"], t("part"), ["p_partkey"]),
                                  (["l_suppkey"], t("supplier"), ["s_suppkey"])]),
        tb.check_constraints(t("labels"), "labels", pk=["doc_id"],
                             fks=[(["doc_id"], t("documents"), ["doc_id"])]),
    ]
    out = reps[0]
    for r in reps[1:]:
        out = out.unionByName(r)
    return out


def _bars_v2(spark, sf_dir):
    """A second delivery of the daily bars from 2000 on (open/close by customer key)."""
    o = fx.table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    return (o.groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"))
            .agg(F.min_by("o_totalprice", F.struct("o_custkey", "o_orderkey")).alias("open"),
                 F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"),
                 F.max_by("o_totalprice", F.struct("o_custkey", "o_orderkey")).alias("close")))


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: the second delivery replaces the first on (symbol, ts)."""
    return round_doubles(tb.upsert(fx.day_bars(spark, sf_dir), _bars_v2(spark, sf_dir), ["symbol", "ts"], ["close"]))


def merge_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concatenation of both deliveries, the later source wins per key."""
    return round_doubles(tb.merge_bars([fx.day_bars(spark, sf_dir), _bars_v2(spark, sf_dir)]))


def clean_minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 + A8 on minute bars (tick count plays the volume column)."""
    b = fx.minute_bars(spark, sf_dir).withColumnRenamed("n_ticks", "Volume")
    return round_doubles(tb.drop_zero_volume(tb.clean_bars(b)))


def collection_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing without vectors, ordered by session, logic type and id,
    after adding a defaulted column for old rows."""
    d = tb.evolve_schema(fx.developed_fx(spark, sf_dir), {"notes": ("string", "")})
    listed = d.where(~F.col("overfitting_flag")).select("trading_session", "logic_type", "id", "sharpe",
                                                         "notes")
    return round_doubles(listed).orderBy("trading_session", "logic_type", "id")


def knowledge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of an earlier crawl (en, fr) refreshed by a full crawl
    without force: old URLs are reported, new ones added; then one host removed."""
    p = fx.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), "url",
        F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"),
        F.col("html").alias("content"))
    lang = F.regexp_extract("url", r"://[^/]+/([a-z]{2})/", 1)
    t0 = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    t1 = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    old = p.where(lang.isin("en", "fr")).withColumns({"added_at": t0, "last_fetched": t0})
    merged = tb.add_knowledge_pages(old, p, t1)
    return merged.select("id", "url", "added_at", "last_fetched", "status",
                         F.length("content").alias("content_length"))


# A contract of one point per unit of price: order totals move by some 100 000, and a
# capital that carries that.  The gates are the reference's but for two values: a window
# of two years has half the trades, and prices without a trend have half the Sharpe.
ADMISSION_CONTRACT = bt.Contract(point_value=1.0, commission=0.0, slippage=1.0, init_cash=5_000_000.0)
WINDOW_GATE = {**mt.ADMISSION_GATE, "sharpe_min": 0.6, "min_trades": 40}
WINDOW_STRICT = {**mt.STRICT_GATE, "sharpe_min": 0.7, "min_trades": 50}


def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H12–H15, B12 on back-test and walk-forward rows: for each symbol and window the
    combination that walk-forward chose, with its in-sample measures.  It is admitted if
    it passes the screening gate and its out-of-sample test has run; over-fitted ones
    are admitted too, flagged and queued for review.  ``strict_passed`` is the second
    stage of the gate."""
    from barlake.plans import wfaplans as wp
    m, kept = wp.segment_metrics(spark, sf_dir, ADMISSION_CONTRACT)
    key = [*wp.KEYS, "k"]
    best = wf.pick_best(m, wp.KEYS, ["fast_period", "slow_period"])
    inside = m.where("segment = 'is'").select(*key, "combo_idx", "sharpe", "max_drawdown", "profit_factor", "total_trades")
    x = best.join(inside, [*key, "combo_idx"]).join(kept.select(*key, "window_idx"), key)
    x = mt.gate_two_stage(x, WINDOW_GATE, WINDOW_STRICT)
    over = wf.overfit_flag(F.col("is_sharpe"), F.col("oos_sharpe"))
    admitted = F.col("screen_passed") & F.col("oos_sharpe").isNotNull()
    return x.select(*wp.KEYS, "window_idx", "combo_idx", "screen_passed", "strict_passed", over.alias("overfit"),
                    admitted.alias("admitted"), (admitted & over).alias("review_queue"),
                    F.coalesce(oa.classify_failure(x, WINDOW_GATE), F.lit("passed")).alias("failure_reason"))


def collection_upsert(spark: SparkSession, sf_dir: str, dim: int = 64) -> DataFrame:
    """A re-embedding batch (logic type 9, new vectors) replaces rows by id
    after the dimension check; summary per id of the resulting collection."""
    from barlake.operators import retrieval as rv
    d = fx.developed_fx(spark, sf_dir).select("id", "logic_type", F.col("semantic_vector").alias("vec"))
    new = fx.developed_fx(spark, sf_dir).where(F.col("logic_type") == 9).select(
        "id", "logic_type", F.col("metadata_vector").alias("vec"))
    ok, _ = rv.check_dim(new, "vec", dim)
    up = tb.upsert(d, ok, ["id"])
    return round_doubles(up.select("id", "logic_type", F.size("vec").alias("dim"),
                                   F.col("vec")[0].cast("double").alias("first_component")))
