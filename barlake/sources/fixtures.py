"""Bar and log tables derived from the driver's tables.

There is no market-data table in the driver's data, so deterministic
projections stand in (FIXTURES.md §3).  Every one is plain DataFrame code over
the parquet tables, so its size grows with the scale factor; the DuckDB
oracle builds the same tables with the SQL in :mod:`barlake.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events → (symbol, ts, price, event_id)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), "ts",
        (F.lit(10000.0) + F.col("value")).alias("price"), "event_id")


def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticks aggregated to one-minute OHLC bars (open/close by (ts, event_id))."""
    from barlake.operators.bars import ticks_to_bars
    return ticks_to_bars(ticks(spark, sf_dir), "1m")


def faulty_minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute bars as a faulty feed gives them: opens that jump, highs below lows, opens
    that are not positive, missing closes and bars without a trade."""
    m = F.minute("ts")
    b = minute_bars(spark, sf_dir)
    swap = m % 19 == 5
    return b.select("symbol", "ts",
                    F.when(m % 17 == 3, F.col("open") * 1.2).when(m % 31 == 13, F.lit(-1.0)).otherwise(F.col("open")).alias("open"),
                    F.when(swap, F.col("low") - 1).otherwise(F.col("high")).alias("high"),
                    F.when(swap, F.col("high") + 1).otherwise(F.col("low")).alias("low"),
                    F.when(m % 29 != 11, F.col("close")).alias("close"),
                    F.when(m % 23 == 7, F.lit(0)).otherwise(F.col("n_ticks")).cast("long").alias("Volume"))


def day_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders → daily OHLC per order priority; open/close by order key."""
    o = table(spark, sf_dir, "orders")
    return (o.groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"))
            .agg(F.min_by("o_totalprice", "o_orderkey").alias("open"),
                 F.max("o_totalprice").alias("high"),
                 F.min("o_totalprice").alias("low"),
                 F.max_by("o_totalprice", "o_orderkey").alias("close")))


def trades_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem → closed trades (strategy, exit_ts, order keys, pnl)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("strategy"), F.col("l_shipdate").alias("exit_ts"),
                     F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"),
                     (F.col("l_extendedprice") * (F.col("l_discount") - F.lit(0.05))).alias("pnl"))


def calls_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events → model-call log (provider, request, cost, tokens, success)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("call_id"),
        F.col("event_type").alias("provider"),
        F.col("user_id").alias("request"),
        (F.col("value") / F.lit(1000.0)).alias("cost_usd"),
        (F.get_json_object("props", "$.k").cast("long") * F.lit(100)).alias("tokens"),
        (F.col("event_type") != F.lit("error")).alias("success"),
        F.col("ts").alias("created_at"))


def developed_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings → developed-strategy collection."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"),
        F.col("embedding").alias("semantic_vector"),
        F.reverse("embedding").alias("metadata_vector"),
        F.col("label").alias("logic_type"),
        (F.col("vec_id") % 4).cast("int").alias("trading_session"),
        ((F.col("vec_id") % 37) / F.lit(10.0)).alias("sharpe"),
        ((F.col("vec_id") % 11) == 0).alias("overfitting_flag"))


def failed_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.where(F.col("label") == 9).select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("semantic_vector"), "label")


def outputs_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations' assistant turns wrapped as model outputs, by conv_id % 4:
    fenced JSON, bare JSON, JSON inside prose, broken JSON."""
    cv = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    obj = F.to_json(F.struct(F.col("text").alias("analysis"), F.array(F.struct(
        F.concat(F.lit("s"), F.col("turn").cast("string")).alias("title"),
        F.struct(F.col("turn").alias("k")).alias("new_params"))).alias("suggestions")))
    kind = F.col("conv_id") % 4
    wrapped = (F.when(kind == 0, F.concat(F.lit("Here is the plan:\n```json\n"), obj, F.lit("\n```\n")))
               .when(kind == 1, obj)
               .when(kind == 2, F.concat(F.lit("Result follows "), obj, F.lit(" end.")))
               .otherwise(F.concat(F.lit("```json\n"), F.substring(obj, 2, 1 << 30), F.lit("\n```"))))
    return cv.select("conv_id", "turn", F.col("text").alias("source_text"), wrapped.alias("output"))


def validation_log_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events → script validation log (strategy, layer, passed, message, created_at)."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    msg = (F.when(F.col("event_type") == "error",
                  F.format_string("Unknown identifier 'V%d' at line %d", k % 7, F.col("event_id") % 50))
           .when(F.col("event_type") == "click", F.format_string("Mismatched 'Begin' at line %d", F.col("event_id") % 50))
           .when(F.col("event_type") == "view", F.format_string("Expected ';' at line %d", F.col("event_id") % 50))
           .otherwise(F.lit("Compiler warning")))
    return ev.select(F.col("event_id").alias("log_id"), F.col("user_id").alias("strategy_id"),
                     ((F.col("event_id") % 3) + 1).cast("int").alias("layer"),
                     (F.col("event_type").isin("error", "click", "view") == F.lit(False)).alias("passed"),
                     msg.alias("message"), F.col("ts").alias("created_at"))


# Prompt steps of the five-step generation flow
PROMPT_STEPS = ["step1_intent", "step2_retrieve", "step3_skeleton", "step4_el", "step5_critique"]


def calls_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """calls_fx plus a prompt step and latency derived from the event."""
    c = calls_fx(spark, sf_dir)
    steps = F.array(*[F.lit(s) for s in PROMPT_STEPS])
    return c.withColumns({
        "prompt_step": F.element_at(steps, (F.col("call_id") % len(PROMPT_STEPS) + 1).cast("int")),
        "latency_ms": (F.col("tokens") / F.lit(10)).cast("long")})


def outcomes_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back-filled downstream outcome per request: a request 'passed' when its
    user has a purchase event."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.col("user_id").alias("request")).agg(
        F.max((F.col("event_type") == "purchase").cast("int")).cast("boolean")
        .alias("downstream_strategy_passed"))


def spread(df: DataFrame) -> DataFrame:
    """Spread CPU-heavy per-row work (regexes, parsing, encoders) over at
    least every core: when the scan yields fewer splits than the default
    parallelism (e.g. a file with a single row group), round-robin
    repartition; otherwise leave the scan's splits alone."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
