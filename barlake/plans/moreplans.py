"""Named plans: faulty feeds, registry escapes, signal alignment, metric runs, knowledge
context by tag, script summaries, cascades, key figures and category searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.operators import backtest as bt
from barlake.operators import opsanalytics as oa
from barlake.operators import quality as qa
from barlake.operators import retrieval as rv
from barlake.operators import signals as sg
from barlake.operators import textops as tx
from barlake.operators.sequence import sequence
from barlake.plans.backtests import KEYS, day_bar_seq
from barlake.plans.common import round_doubles
from barlake.sources import fixtures as fx
from barlake.sources import stored as st
from barlake.sources import tables as tb


def _faulty(spark, sf_dir):
    x, bl = sequence(fx.faulty_minute_bars(spark, sf_dir), KEYS, ["ts"])
    return qa.flag_bars(x, KEYS, block=bl)


def faulty_price_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8 on a feed that jumps."""
    return round_doubles(_faulty(spark, sf_dir).where("is_jump").select("symbol", "ts", "open", "prev_close"))


def faulty_bar_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E10 + D12 on a feed with every kind of fault."""
    return round_doubles(qa.quality_report(_faulty(spark, sf_dir), KEYS))


def faulty_bars_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 + A8: bars with a missing price, a high below the low, an open that is not
    positive or no volume go."""
    return round_doubles(tb.drop_zero_volume(tb.clean_bars(fx.faulty_minute_bars(spark, sf_dir))))


def signals_trend_breakout_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G9 with the extreme of the bars before, which can fire."""
    b, bl = day_bar_seq(spark, sf_dir)
    return sg.trend_breakout(b, KEYS, prior=True, block=bl).select("symbol", "ts", "signal")


def _month_momentum(pdf, lookback: int = 2):
    """Long above the close of ``lookback`` bars before, short below."""
    import numpy as np
    return np.sign(pdf["close"] - pdf["close"].shift(lookback))


def pandas_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pandas strategy by month, registered, run and taken out again."""
    name = "Month_Momentum"
    sg.register_pandas_strategy(name, _month_momentum, {"lookback": 2}, period="month", category="trend")
    try:
        return sg.run_strategy(name, fx.day_bars(spark, sf_dir), KEYS).select("symbol", "ts", "signal")
    finally:
        del sg.REGISTRY[name]


def aligned_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SMA cross's signals looked up among the bars of each day."""
    b, bl = day_bar_seq(spark, sf_dir)
    s = sg.ma_cross(b, KEYS, 20, 60, block=bl).where("signal <> 0").select("symbol", "ts", "signal")
    return round_doubles(bt.align_signals(fx.day_bars(spark, sf_dir), s).select("symbol", "ts", "close", "signal"))


def metric_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider success rates of two phases appended to one metric table."""
    path = st.new_table(spark, "metrics")
    calls = fx.calls_log(spark, sf_dir)
    for phase, part in ((1, calls.where(F.col("call_id") % 2 == 0)), (3, calls)):
        tb.append_metric_run(part.groupBy("provider").agg(
            F.avg(F.col("success").cast("double")).alias("value"), F.max("created_at").alias("created_at")).select(
            F.concat(F.lit("success:"), "provider").alias("metric_name"), "value", F.lit(phase).alias("phase"), "created_at"), path)
    return round_doubles(spark.read.parquet(path))


TAG_FILTERS = ["", "EN", "fr", "shop", "zz"]


def knowledge_context_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of the page knowledge base for several tag filters; every ninth
    page was not fetched, of every fifth it is not known, some have no tags."""
    from barlake.plans.textplans import _pages
    i = F.col("page_id")
    lang = F.regexp_extract("url", r"://[^/]+/([a-z]{2})/", 1)
    tags = F.when(i % 7 != 3, F.concat(F.upper(lang), F.lit(","), tx.url_host("url")))
    p = _pages(spark, sf_dir).select(i.alias("id"), "url", "title", tags.alias("tags"), F.col("text").alias("content"),
                                     F.when(i % 5 != 0, i % 9 != 0).alias("fetch_ok"))
    return tx.knowledge_context(p, TAG_FILTERS)


def script_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K20 over every document as a script, some with declarations before the text."""
    i = F.col("doc_id")
    head = F.concat(F.when(i % 2 == 0, "INPUTS: n(5);\n").otherwise(""), F.when(i % 3 == 0, "Variables: v(0);\n").otherwise(""),
                    F.when(i % 5 < 3, "// buy later\n  Buy Next Bar at Market;\n").otherwise(""), F.when(i % 7 < 5, "SELL short;\n\n").otherwise(""))
    d = fx.spread(fx.table(spark, sf_dir, "documents")).select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("code"))
    return d.select("doc_id", tx.missing_declarations("code").alias("missing"), tx.effective_lines("code").alias("effective_lines"))


CASCADE = ["error", "view", "click"]


def first_success_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K13 in cascade order: the first provider of the cascade that succeeded."""
    return oa.first_success_cascade(fx.calls_log(spark, sf_dir), CASCADE)


def _dated(spark, sf_dir):
    """The collection with a drawdown and the time each strategy was added."""
    d = fx.developed_fx(spark, sf_dir)
    return d.withColumns({"max_drawdown": (F.col("id") % 51) / 100.0,
                          "added_at": F.timestamp_add("HOUR", F.col("id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))})


def kpi_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's figures with this week's additions and the mean drawdown."""
    return round_doubles(oa.kpi_dashboard(_dated(spark, sf_dir)))


def kpi_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution by session and by logic type."""
    return oa.kpi_distribution(fx.developed_fx(spark, sf_dir), ["trading_session", "logic_type"])


def _recorded(spark, sf_dir):
    """The collection with each strategy's fields and its record as JSON; every 13th
    record is broken."""
    d = fx.developed_fx(spark, sf_dir)
    holding = F.when(F.col("trading_session") < 2, "daytrade").otherwise("swing")
    category = F.element_at(F.array(*map(F.lit, rv.LOGIC_KEYWORDS)), (F.col("logic_type") % 6 + 1).cast("int"))
    rec = F.to_json(F.struct(F.format_string("S%d", F.col("id")).alias("name"), category.alias("category"), "sharpe"))
    return d.withColumns({"holding": holding, "category": category, "record": F.when(F.col("id") % 13 == 0, F.substring(rec, 1, 9)).otherwise(rec)})


def find_similar_records(spark: SparkSession, sf_dir: str, k: int = 2) -> DataFrame:
    """I7 for every strategy as a query: its category and holding type filter the
    collection of those that are not over-fitted; text assembled, records restored."""
    c = _recorded(spark, sf_dir)
    text = rv.query_text(F.col("category"), F.col("holding"), F.lit("5min"), F.lit("both"), F.when(F.col("id") % 3 == 0, "ATR stop loss"))
    q = c.select(F.col("id").alias("qid"), F.col("semantic_vector").alias("qvec"), F.col("category").alias("q_category"),
                 F.col("holding").alias("q_holding"), text.alias("query"))
    r = rv.find_similar_records(q, c.where("NOT overfitting_flag"), k, "record", "name string, category string, sharpe double",
                                [("q_category", "category"), ("q_holding", "holding")], c_vec="semantic_vector", exclude_self=True)
    return round_doubles(q.select("qid", "query").join(r, "qid"))


def sample_examples_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I15 for every logic type: five examples, its own first."""
    d = fx.developed_fx(spark, sf_dir).select("id", "logic_type", "sharpe")
    return round_doubles(rv.sample_examples_by_category(d, "logic_type", 5, name_col="id"))


def recall_keyword_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I9 with the query's own text: an expected keyword found there is a hit too."""
    from barlake.plans.retrievalplans import _keyword_ranked
    i = F.col("qid") % 10
    r = _keyword_ranked(spark, sf_dir, 5).withColumn("query", F.when(i == 3, "swing momentum entries").when(
        i == 8, "Momentum of the week").when(i == 4, "fade the opening range").otherwise("find similar"))
    hit = F.coalesce(rv.keyword_hit(F.col("expected"), F.col("text"), F.col("query")), F.lit(False))
    per = rv.recall_mrr(r, "qid", hit)
    return round_doubles(per.groupBy((F.col("qid") % 10).alias("kind")).agg(F.count(F.lit(1)).alias("n_cases"), F.avg("hit_at_k").alias("recall_at_5")))
