"""Named plans: diagnostics, segment labels, report tables, intents, prompt blocks,
embedding texts and the library encoder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlake.operators import metrics as mt
from barlake.operators import textops as tx
from barlake.operators.sequence import Sum, rolling, scan, sequence
from barlake.plans.backtests import KEYS
from barlake.plans.common import round_doubles
from barlake.plans.reportplans import _ledger
from barlake.sources import fixtures as fx


def rolling_sharpe(spark: SparkSession, sf_dir: str, n: int = 60) -> DataFrame:
    """Sharpe of the last 60 bar returns (daily annualisation, √245)."""
    led, bl = _ledger(spark, sf_dir)

    def st(w):
        fr = w.rowsBetween(-(n - 1), 0)
        ok = F.count("ret").over(fr) == n
        sd = F.stddev_samp("ret").over(fr)
        return {"rolling_sharpe": F.when(ok & (sd > 0), F.avg("ret").over(fr) / sd * F.sqrt(F.lit(245.0)))}
    return round_doubles(rolling(led, KEYS, st, n - 1, block=bl).select("symbol", "ts", "rolling_sharpe"))


def pnl_histogram(spark: SparkSession, sf_dir: str, buckets: int = 10) -> DataFrame:
    """Trade PnL histogram per symbol (equal-width buckets; the maximum
    falls in bucket n+1 as with ``width_bucket``)."""
    led, _ = _ledger(spark, sf_dir)
    t = led.where(F.col("trade_pnl").isNotNull()).select("symbol", F.col("trade_pnl").alias("pnl"))
    r = t.groupBy("symbol").agg(F.min("pnl").alias("lo"), F.max("pnl").alias("hi"))
    x = t.join(r, "symbol")
    b = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(
        (F.floor((F.col("pnl") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets) + 1).cast("int"))
    return x.groupBy("symbol", b.alias("bucket")).agg(F.count(F.lit(1)).alias("n_trades"))


def drawdown_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps-and-islands over the underwater flag: each episode's start,
    end, length and depth."""
    led, bl = _ledger(spark, sf_dir)
    x = led.withColumn("_uw", F.col("equity") < F.col("peak"))
    x = scan(x, KEYS, {"_isl": (Sum(), (~F.col("_uw")).cast("long"))}, block=bl)
    g = x.where("_uw").groupBy("symbol", "_isl").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("n_bars"),
        F.min("drawdown").alias("depth"))
    return round_doubles(g.drop("_isl"))


def split_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train / test / outside labels by date range, counted per symbol."""
    b = fx.day_bars(spark, sf_dir)
    ts = F.col("ts")
    seg = (F.when((ts >= F.lit("1995-01-01").cast("timestamp_ntz")) & (ts <= F.lit("1999-12-31 23:59:59").cast("timestamp_ntz")), "train")
           .when((ts >= F.lit("2000-01-01").cast("timestamp_ntz")) & (ts <= F.lit("2001-12-31 23:59:59").cast("timestamp_ntz")), "test")
           .otherwise("outside"))
    return b.groupBy("symbol", seg.alias("segment")).agg(F.count(F.lit(1)).alias("n_bars"),
                                                          F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def unpaired_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels without a document and documents without labels (anti joins)."""
    d = fx.table(spark, sf_dir, "documents").select("doc_id")
    lb = fx.table(spark, sf_dir, "labels").select("doc_id")
    a = lb.join(d, "doc_id", "left_anti").withColumn("side", F.lit("label_without_document"))
    b = d.join(lb, "doc_id", "left_anti").withColumn("side", F.lit("document_without_label"))
    return a.unionByName(b)


def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics unpivoted beside their thresholds with pass/fail per line."""
    from barlake.plans.backtests import ma_cross_backtest_metrics
    m = ma_cross_backtest_metrics(spark, sf_dir)
    long_ = m.unpivot(["symbol"], ["sharpe", "max_drawdown", "profit_factor",
                                   F.col("total_trades").cast("double").alias("total_trades")],
                      "metric", "value")
    g = mt.SCREEN_GATE
    thr = spark.createDataFrame([("sharpe", g["sharpe_min"], ">="), ("max_drawdown", g["max_drawdown_max"], "<="),
                                 ("profit_factor", g["profit_factor_min"], ">="),
                                 ("total_trades", float(g["min_trades"]), ">=")],
                                "metric string, threshold double, rule string")
    x = long_.join(F.broadcast(thr), "metric")
    ok = F.when(F.col("rule") == ">=", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return x.withColumn("passed", F.coalesce(ok, F.lit(False)))


def strategy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per symbol KPIs with the walk-forward window table as ordered text."""
    from barlake.plans.backtests import ma_cross_backtest_metrics
    from barlake.plans.wfaplans import wfa_windows
    m = ma_cross_backtest_metrics(spark, sf_dir).select("symbol", "sharpe", "max_drawdown", "profit_factor",
                                                        "total_trades", "passed")
    w = wfa_windows(spark, sf_dir)
    line = F.format_string("[%02d] IS %s..%s OOS %s..%s IS=%.2f OOS=%.2f", F.col("window_idx"),
                           F.col("is_start").cast("string"), F.col("is_end").cast("string"),
                           F.col("oos_start").cast("string"), F.col("oos_end").cast("string"),
                           F.col("is_sharpe"), F.col("oos_sharpe"))
    t = w.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("window_idx", line.alias("l")))).alias("_w"))
    t = t.select("symbol", F.array_join(F.transform("_w", lambda e: e["l"]), "\n").alias("windows"))
    return m.join(t, "symbol", "left")


# Accepted intent values
SESSION_CLASSES = ["daytrade_day", "daytrade_night", "swing_day", "swing_full"]
LOGIC_TYPES = ["trend", "mean_reversion", "tunnel", "pattern"]
TIMEFRAMES = ["1min", "5min", "15min", "30min", "60min", "1d"]
DISABLED_LOGIC = ["pattern"]


def validate_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents (JSON derived from the event log) checked against the
    enumerations; disabled types and confidence < 0.7 go to clarification."""
    ev = fx.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    sess = F.element_at(F.array(*[F.lit(s) for s in SESSION_CLASSES + ["allday"]]), (k % 5 + 1))
    logic = F.element_at(F.array(*[F.lit(s) for s in LOGIC_TYPES]), (F.col("user_id") % 4 + 1).cast("int"))
    tf = F.element_at(F.array(*[F.lit(s) for s in TIMEFRAMES + ["2min"]]), (F.col("event_id") % 7 + 1).cast("int"))
    js = F.to_json(F.struct(sess.alias("trading_session"), logic.alias("logic_type"), tf.alias("timeframe"),
                            F.round(F.col("value") / F.lit(500.0), 4).alias("confidence")))
    x = ev.select("event_id", js.alias("intent"))
    g = lambda p: F.get_json_object("intent", p)
    reasons = F.filter(F.array(
        F.when(~g("$.trading_session").isin(*SESSION_CLASSES), F.lit("bad_session")),
        F.when(~g("$.logic_type").isin(*LOGIC_TYPES), F.lit("bad_logic")),
        F.when(~g("$.timeframe").isin(*TIMEFRAMES), F.lit("bad_timeframe")),
        F.when(g("$.logic_type").isin(*DISABLED_LOGIC), F.lit("disabled_logic")),
        F.when(g("$.confidence").cast("double") < 0.7, F.lit("low_confidence"))), lambda r: r.isNotNull())
    return x.select("event_id", F.array_join(reasons, ",").alias("reasons"),
                    (F.size(reasons) == 0).alias("accepted"))


def prompt_blocks(spark: SparkSession, sf_dir: str, n: int = 3) -> DataFrame:
    """I16: per logic type the best three strategies as one Markdown block."""
    d = fx.developed_fx(spark, sf_dir)
    w = Window.partitionBy("logic_type").orderBy(F.col("sharpe").desc(), F.col("id"))
    top = d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    blk = F.format_string("### Strategy %d\n- session: %d\n- sharpe: %.1f\n", F.col("id"),
                          F.col("trading_session"), F.col("sharpe"))
    g = top.groupBy("logic_type").agg(F.array_sort(F.collect_list(F.struct("_r", blk.alias("b")))).alias("_l"))
    return g.select("logic_type", F.array_join(F.transform("_l", lambda e: e["b"]), "\n").alias("block"))


def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata (≤ 200 chars) and semantic texts built from document
    records; the whole text is kept (no clipping of the body)."""
    d = fx.spread(fx.table(spark, sf_dir, "documents"))
    meta = F.substring(F.concat_ws(" | ", F.concat(F.lit("lang="), "lang"), F.concat(F.lit("source="), "source"),
                                   F.concat(F.lit("chars="), F.col("n_chars").cast("string"))), 1, 200)
    sem = F.concat_ws("\n", F.concat(F.lit("source: "), "source"), F.col("text"))
    return d.select("doc_id", meta.alias("metadata_text"), F.length(sem).alias("semantic_chars"),
                    F.sha2(sem, 256).alias("semantic_hash"))


def embed_documents(spark: SparkSession, sf_dir: str, dim: int = 256) -> DataFrame:
    """The built-in encoder — tokens → hashed term frequencies → L2
    normalised float vectors (JVM-side pyspark.ml stages)."""
    from barlake.operators.embedding import hashing_encoder
    d = fx.spread(fx.table(spark, sf_dir, "documents")).select("doc_id", "text")
    return hashing_encoder(d, "text", "embedding", dim).select("doc_id", "embedding")


def failure_convergence(spark: SparkSession, sf_dir: str, nth: int = 50, horizon: int = 100) -> DataFrame:
    """For each failure pattern, of the ``horizon`` log events after its
    50th occurrence, how many repeat it (target < 10)."""
    v = fx.validation_log_fx(spark, sf_dir).where(~F.col("passed")).withColumn(
        "pattern", tx.normalise_error("message")).withColumn("_all", F.lit(1))
    s, bl = sequence(v, ["_all"], ["created_at", "log_id"], ranged=True)
    # occurrence number inside a pattern: numbered through the blocked kernel,
    # since one pattern may hold a large share of the log
    occ, _ = sequence(s.withColumnRenamed("_ord", "_gord"), ["pattern"], ["_gord"],
                      ranged=True)
    o50 = occ.where(F.col("_ord") == nth - 1).select("pattern", F.col("_gord").alias("_o50"))
    j = s.select("pattern", "_ord").join(o50, "pattern")
    win = (F.col("_ord") > F.col("_o50")) & (F.col("_ord") <= F.col("_o50") + horizon)
    g = j.groupBy("pattern").agg(F.count_if(win).alias("repeats_in_next"))
    return g.withColumn("converged", F.col("repeats_in_next") < 10)


# --------------------------------------------------------------------------
# single-measure views under the key names of SURVEY §7.5
# --------------------------------------------------------------------------

def price_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars whose open jumps more than 5 % from the previous close."""
    from barlake.plans.barplans import bar_flags
    return bar_flags(spark, sf_dir).where("is_jump").select("symbol", "ts", "prev_close")


def recall_at_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barlake.plans.retrievalplans import retrieval_eval
    return retrieval_eval(spark, sf_dir).select("n_cases", "recall_at_5")


def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barlake.plans.retrievalplans import retrieval_eval
    return retrieval_eval(spark, sf_dir).select("n_cases", "mrr")


def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barlake.plans.textplans import page_title_text
    return page_title_text(spark, sf_dir).select("page_id", "title", "title_or_url")


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barlake.plans.textplans import page_title_text
    return page_title_text(spark, sf_dir).select("page_id", "text", "n_chars")


def fenced_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3 on the wrapped model outputs: the json fence, else a bare fence, else ''."""
    o = fx.spread(fx.outputs_fx(spark, sf_dir))
    b = tx.fenced_block(F.col("output"), ("json", ""), False)
    return o.select("conv_id", "turn", b.alias("block")).select(
        "conv_id", "turn", F.length("block").alias("block_chars"), F.sha2("block", 256).alias("block_hash"))
