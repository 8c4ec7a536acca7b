"""Named plans: cost, failure and quality reporting on the call log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.operators import opsanalytics as oa
from barlake.operators.sequence import sequence
from barlake.plans.common import round_doubles
from barlake.sources import fixtures as fx


def budget_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(oa.budget_status(fx.calls_log(spark, sf_dir)))


def budget_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(oa.budget_breakdown(fx.calls_log(spark, sf_dir)))


def daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oa.daily_rollup(fx.calls_log(spark, sf_dir))


def running_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.calls_log(spark, sf_dir).withColumn("day", F.to_date("created_at"))
    s, bl = sequence(c, ["day"], ["created_at", "call_id"], ranged=True)
    out = oa.running_spend(s, block=bl)
    return round_doubles(out.select("call_id", "day", "provider", "spent", "spent_before", "mode", "allowed"))


def fail_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.calls_log(spark, sf_dir)
    s, bl = sequence(c, ["request"], ["created_at", "call_id"], bucket=F.to_date("created_at"))
    out = oa.fail_streaks(s, ["request"], ~F.col("success"), 3, block=bl)
    return out.select("call_id", "request", "fail_streak", "alert")


def provider_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(oa.provider_rates(fx.calls_log(spark, sf_dir)))


def layer_pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(oa.layer_pass_rates(fx.validation_log_fx(spark, sf_dir)))


def cost_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(oa.cost_quality(fx.calls_log(spark, sf_dir), fx.outcomes_fx(spark, sf_dir)))


def step_failure_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(oa.step_failure_rates(fx.calls_log(spark, sf_dir)))


def first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oa.first_success(fx.calls_log(spark, sf_dir))


def weekly_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(oa.weekly_quality(fx.calls_log(spark, sf_dir)))


def metric_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E15 on the daily success rate of every provider."""
    c = fx.calls_log(spark, sf_dir)
    m = c.groupBy("provider", F.to_date("created_at").alias("day")).agg(
        F.avg(F.col("success").cast("double")).alias("value"))
    return round_doubles(oa.metric_regression(m, ["provider"], "day", "value"))


def recent_failures(spark: SparkSession, sf_dir: str, n: int = 20) -> DataFrame:
    """The last n failed calls, newest first (the limit is the feature)."""
    c = fx.calls_log(spark, sf_dir).where(~F.col("success"))
    return c.orderBy(F.col("created_at").desc(), F.col("call_id").desc()).limit(n).select(
        "call_id", "request", "provider", "created_at")


def kpi_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D14 over the strategy collection: counts, means, review queue and the
    distribution by session (one pass)."""
    d = fx.developed_fx(spark, sf_dir)
    return round_doubles(d.agg(
        F.count(F.lit(1)).alias("strategy_count"), F.avg("sharpe").alias("avg_sharpe"),
        F.count_if("overfitting_flag").alias("overfitting_count"),
        F.count_if(F.col("overfitting_flag") & (F.col("sharpe") >= 1.2)).alias("pending_review_count"),
        *[F.count_if(F.col("trading_session") == s).alias(f"session_{s}") for s in range(4)],
        F.count_distinct("logic_type").alias("logic_types")))


def latest_trade_per_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: supplier (strategy detail) with its newest trade."""
    sup = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("strategy"), "s_name")
    t = fx.trades_fx(spark, sf_dir)
    return round_doubles(oa.latest_per_key(sup, t, "strategy", ["exit_ts", "orderkey", "linenumber"],
                                           ["exit_ts", "orderkey", "pnl"]))


def list_strategies_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logic type 3 with Sharpe ≥ 1, by Sharpe desc, second page of 20."""
    d = fx.developed_fx(spark, sf_dir).select("id", "logic_type", "trading_session", "sharpe")
    return oa.list_page(d, (F.col("logic_type") == 3) & (F.col("sharpe") >= 1.0), "sharpe", True, "id", 1, 20)
