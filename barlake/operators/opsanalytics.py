"""Cost, failure and quality reporting over call and validation logs
(D14–D20, E14–E17, E19, K13, C4, C6, B10, B12, H12–H15).

Running quantities (spend within a day, failure streaks) go through the
blocked scan kernel keyed by day / request, so one busy day or one chatty
request never has to fit in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.operators.sequence import Last, Sum, scan

# Daily budget (USD) and its mode thresholds (lower bounds inclusive)
DAILY_LIMIT = 10.0
NORMAL_UNTIL, THROTTLE_UNTIL, SURVIVAL_UNTIL = 7.0, 9.5, 10.0
# Daily attempt stop rule
MAX_DAILY_FAILURES, MAX_DAILY_TOKENS = 10, 1_000_000
# Provider tiers used by the degradation modes of the fixture log
PREMIUM_PROVIDERS = ["purchase"]
ECONOMY_PROVIDERS = ["view"]


def budget_mode(spent: Column) -> Column:
    return (F.when(spent < NORMAL_UNTIL, F.lit("normal")).when(spent < THROTTLE_UNTIL, F.lit("throttle"))
            .when(spent < SURVIVAL_UNTIL, F.lit("survival")).otherwise(F.lit("hard_stop")))


def budget_status(calls: DataFrame, ts: str = "created_at") -> DataFrame:
    """D15 per day: spend, limit, share, mode and the calendar-week total."""
    d = calls.groupBy(F.to_date(ts).alias("day")).agg(F.sum("cost_usd").alias("today_used_usd"),
                                                       F.count(F.lit(1)).alias("n_calls"))
    wk = d.groupBy(F.date_trunc("week", "day").cast("date").alias("week")).agg(
        F.sum("today_used_usd").alias("this_week_total_usd"))
    d = d.withColumn("week", F.date_trunc("week", "day").cast("date")).join(wk, "week").drop("week")
    return d.withColumns({"today_limit_usd": F.lit(DAILY_LIMIT),
                          "today_used_percent": F.col("today_used_usd") / F.lit(DAILY_LIMIT),
                          "current_mode": budget_mode(F.col("today_used_usd"))})


def budget_breakdown(calls: DataFrame, ts: str = "created_at") -> DataFrame:
    """D15 by provider and by step per day in one pass (grouping sets)."""
    x = calls.withColumn("day", F.to_date(ts))
    g = x.groupingSets([["day", "provider"], ["day", "prompt_step"], ["day"]], "day", "provider",
                       "prompt_step").agg(F.sum("cost_usd").alias("cost_usd"),
                                          F.count(F.lit(1)).alias("n_calls"))
    dim = (F.when(F.col("provider").isNotNull(), F.lit("provider"))
           .when(F.col("prompt_step").isNotNull(), F.lit("step")).otherwise(F.lit("total")))
    return g.select("day", dim.alias("dimension"), F.coalesce("provider", "prompt_step", F.lit("all")).alias("key"),
                    "cost_usd", "n_calls")


def daily_rollup(calls: DataFrame, ts: str = "created_at") -> DataFrame:
    """Attempts, successes, tokens per day and the stop rule."""
    d = calls.groupBy(F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("success").alias("successes"),
        F.sum("tokens").alias("tokens_used"))
    fails = F.col("attempts") - F.col("successes")
    return d.withColumn("stop", (fails >= MAX_DAILY_FAILURES) | (F.col("tokens_used") >= MAX_DAILY_TOKENS))


def running_spend(calls_seq: DataFrame, block=None) -> DataFrame:
    """Spend of the day before each call (``_ord`` per day), the mode it
    puts the call in and whether the provider may be used in that mode."""
    x = scan(calls_seq, ["day"], {"spent": (Sum(), F.col("cost_usd"))}, exclusive=["spent"], block=block)
    before = F.coalesce(F.col("spent_prev"), F.lit(0.0))
    mode = budget_mode(before)
    p = F.col("provider")
    allowed = (F.when(mode == "normal", F.lit(True))
               .when(mode == "throttle", ~p.isin(*PREMIUM_PROVIDERS))
               .when(mode == "survival", p.isin(*ECONOMY_PROVIDERS)).otherwise(F.lit(False)))
    return x.withColumns({"spent_before": before, "mode": mode, "allowed": allowed}).drop("spent_prev")


def fail_streaks(seq: DataFrame, keys: Sequence[str], failed: Column, alert_at: int = 3,
                 block=None) -> DataFrame:
    """Consecutive failures per key, reset by a success (not by a day
    change); ``alert`` when the streak reaches ``alert_at``."""
    x = seq.withColumn("_f", failed.cast("long"))
    x = scan(x, keys, {"_cf": (Sum(), F.col("_f"))}, block=block)
    x = scan(x, keys, {"_b": (Last(), F.when(F.col("_f") == 0, F.col("_cf")))}, block=block)
    x = x.withColumn("fail_streak", F.col("_cf") - F.coalesce(F.col("_b"), F.lit(0)))
    return x.withColumn("alert", F.col("fail_streak") >= alert_at).drop("_f", "_cf", "_b")


def provider_rates(calls: DataFrame, min_rate: float = 0.30) -> DataFrame:
    """Per provider success rate, mean cost and latency; flag under 30 %."""
    g = calls.groupBy("provider").agg(F.count(F.lit(1)).alias("n_calls"),
                                      F.avg(F.col("success").cast("double")).alias("success_rate"),
                                      F.avg("cost_usd").alias("avg_cost_usd"),
                                      F.avg("latency_ms").alias("avg_latency_ms"))
    return g.withColumn("low_success", F.col("success_rate") < min_rate)


def layer_pass_rates(log: DataFrame) -> DataFrame:
    """Validation pass rate per layer."""
    return log.groupBy("layer").agg(F.count(F.lit(1)).alias("n"),
                                    F.avg(F.col("passed").cast("double")).alias("pass_rate"))


def cost_quality(calls: DataFrame, outcomes: DataFrame) -> DataFrame:
    """C6 + D19: calls left-joined to request outcomes; per provider passing
    requests per dollar, cost per passing request, failure rate."""
    j = calls.join(outcomes, "request", "left")
    ok = F.coalesce(F.col("downstream_strategy_passed"), F.lit(False))
    g = j.groupBy("provider").agg(F.sum("cost_usd").alias("cost_usd"),
                                  F.count_distinct(F.when(ok, F.col("request"))).alias("passed_requests"),
                                  F.avg((~F.col("success")).cast("double")).alias("failure_rate"))
    return g.withColumns({"passed_per_usd": F.try_divide(F.col("passed_requests"), F.col("cost_usd")),
                          "cost_per_pass": F.try_divide(F.col("cost_usd"), F.col("passed_requests"))})


def step_failure_rates(calls: DataFrame) -> DataFrame:
    """Failure rate per prompt step."""
    return calls.groupBy("prompt_step").agg(F.count(F.lit(1)).alias("n_calls"),
                                            F.avg((~F.col("success")).cast("double")).alias("failure_rate"))


def first_success(calls: DataFrame, key: str = "request", ts: str = "created_at") -> DataFrame:
    """Per request the first successful call by completion time, else the
    last failed one."""
    st = F.struct(F.col(ts).alias("at"), F.col("call_id").alias("call_id"), F.col("provider").alias("provider"))
    order = F.struct(F.col(ts), F.col("call_id"))
    g = calls.groupBy(key).agg(F.min_by(F.when(F.col("success"), st), F.when(F.col("success"), order)).alias("_ok"),
                               F.max_by(F.when(~F.col("success"), st), F.when(~F.col("success"), order)).alias("_ko"),
                               F.count(F.lit(1)).alias("n_calls"))
    pick = F.coalesce("_ok", "_ko")
    return g.select(key, "n_calls", F.col("_ok").isNotNull().alias("succeeded"),
                    pick["provider"].alias("provider"), pick["call_id"].alias("call_id"), pick["at"].alias("at"))


def first_success_cascade(calls: DataFrame, cascade: Sequence[str], key: str = "request") -> DataFrame:
    """K13 in cascade order: per request the call of the first provider of ``cascade`` that
    succeeded (its earliest one), else the last call of the last provider tried.
    Providers outside of the cascade come after it, by name."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, cascade)), F.col("provider")), F.lit(0)),
                       F.lit(len(cascade) + 1))
    st = F.struct("provider", "call_id")
    order = F.struct(place.alias("p"), F.col("provider"), F.col("created_at"), F.col("call_id"))
    g = calls.groupBy(key).agg(F.min_by(F.when(F.col("success"), st), F.when(F.col("success"), order)).alias("_ok"),
                               F.max_by(F.when(~F.col("success"), st), F.when(~F.col("success"), order)).alias("_ko"))
    pick = F.coalesce("_ok", "_ko")
    return g.select(key, F.col("_ok").isNotNull().alias("succeeded"), pick["provider"].alias("provider"), pick["call_id"].alias("call_id"))


def kpi_dashboard(strategies: DataFrame, review_sharpe: float = 1.2) -> DataFrame:
    """D14, one row: counts, those added in the week of the newest one, means, review
    queue and over-fitted ones.  Strategies: sharpe, max_drawdown, overfitting_flag, added_at."""
    newest = strategies.agg(F.date_trunc("week", F.max("added_at")).alias("_week"))
    x = strategies.join(F.broadcast(newest))            # one row
    return x.agg(F.count(F.lit(1)).alias("strategy_count"), F.count_if(F.col("added_at") >= F.col("_week")).alias("this_week_added"),
                 F.avg("sharpe").alias("avg_sharpe"), F.avg("max_drawdown").alias("max_drawdown_avg"),
                 F.count_if(F.col("overfitting_flag") & (F.col("sharpe") >= review_sharpe)).alias("pending_review_count"),
                 F.count_if("overfitting_flag").alias("overfitting_count"))


def kpi_distribution(strategies: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Strategies per value of each dimension, in one pass."""
    text = strategies.select(*[F.col(d).cast("string").alias(d) for d in dimensions])
    g = text.groupingSets([[d] for d in dimensions], *dimensions).agg(
        *[F.grouping(d).alias(f"_g_{d}") for d in dimensions], F.count(F.lit(1)).alias("n"))
    name = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.lit(d)) for d in dimensions])
    value = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.col(d)) for d in dimensions])
    return g.select(name.alias("dimension"), value.alias("value"), "n")


def weekly_quality(calls: DataFrame, ts: str = "created_at", drop_points: float = 5.0) -> DataFrame:
    """Weekly totals with the change against the previous week; alert
    when the success rate falls by more than ``drop_points`` points."""
    g = calls.groupBy(F.date_trunc("week", ts).cast("date").alias("week")).agg(
        F.count(F.lit(1)).alias("n_calls"), F.sum("cost_usd").alias("cost_usd"),
        (F.avg(F.col("success").cast("double")) * 100).alias("success_pct"))
    w = Window.orderBy("week")  # one row per week: calendar-bounded
    prev = F.lag("success_pct", 1).over(w)
    return g.withColumns({"success_pct_change": F.col("success_pct") - prev,
                          "alert": F.coalesce(F.col("success_pct") - prev < -drop_points, F.lit(False))})


def metric_regression(metrics: DataFrame, keys: Sequence[str], order: str, value: str,
                      max_fall: float = 0.05) -> DataFrame:
    """Latest vs previous value per metric; warn on a fall above ``max_fall``."""
    w = Window.partitionBy(*keys).orderBy(order)
    prev = F.lag(value, 1).over(w)
    return metrics.withColumns({"previous": prev, "change": F.col(value) - prev,
                                "regressed": F.coalesce(prev - F.col(value) > max_fall, F.lit(False))})


# Failure reasons of the steps before the metrics
STEP_REASONS = {"validation": "el_syntax_error", "compile": "mc_compile_error", "budget": "budget_exhausted",
                "timeout": "llm_timeout"}


def classify_failure(m: DataFrame, gate: dict, failed_step: Column | None = None) -> Column:
    """One reason per failed result.  A step that failed comes first (a step
    without a reason of its own is ``unknown``), then the metrics in fixed order."""
    by_metric = (F.when(F.col("total_trades") < gate["min_trades"], F.lit("insufficient_trades"))
                 .when(F.coalesce(F.col("sharpe") < gate["sharpe_min"], F.lit(False)), F.lit("low_sharpe"))
                 .when(F.col("max_drawdown") > gate["max_drawdown_max"], F.lit("high_drawdown"))
                 .when(F.col("profit_factor") < gate["profit_factor_min"], F.lit("low_profit_factor")))
    if failed_step is None:
        return by_metric
    by_step = F.lit("unknown")
    for step, reason in STEP_REASONS.items():
        by_step = F.when(failed_step == step, reason).otherwise(by_step)
    return F.when(failed_step.isNotNull(), by_step).otherwise(by_metric)


def latest_per_key(parent: DataFrame, child: DataFrame, key: str, order: Sequence[str],
                   child_cols: Sequence[str]) -> DataFrame:
    """C4: each parent with its newest child (max_by on a struct; no window)."""
    o = F.struct(*[F.col(c) for c in order])
    newest = child.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in child_cols]), o).alias("_n"),
                                    F.count(F.lit(1)).alias("n_children"))
    out = parent.join(newest, key, "left")
    return out.select(*parent.columns, "n_children", *[F.col(f"_n.{c}").alias(f"latest_{c}") for c in child_cols])


def list_page(df: DataFrame, filters: Column, sort: str, desc: bool, tiebreak: str, page: int,
              size: int = 20) -> DataFrame:
    """Filter, sort (unique tie-breaker), page offset; size capped at 100."""
    size = min(size, 100)
    o = F.col(sort).desc() if desc else F.col(sort).asc()
    return df.where(filters).orderBy(o, F.col(tiebreak)).offset(page * size).limit(size)
