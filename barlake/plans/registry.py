"""Registry of named queries (Spark plans) and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barlake.plans import extraplans, intradayplans, libraryplans, moreplans, opsplans, storedplans, streamplans, tableplans
from barlake.plans import backtests, barplans, indicatorplans, oracle, reportplans, retrievalplans, textplans, wfaplans

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


# Sums and counts that DuckDB widens beyond BIGINT, per query: the oracle casts
# them back so both results carry the same column types.
WIDE_COLUMNS = {
    "faulty_bar_report": "null_count ohlc_error_count price_jump_count anomaly_count gap_count valid_bars",
    "bar_quality_report": "null_count ohlc_error_count price_jump_count anomaly_count gap_count valid_bars",
    "signal_distribution": "n_long n_short n_flat",
    "trade_durations": "n_closed",
    "loss_streaks": "loss_streak",
    "health_alerts": "loss_streak max_loss_streak",
    "wfa_windows": "n_is n_oos",
    "wfa_summary": "windows_passed",
    "batch_diversity": "n_session_0 n_session_1 n_session_2 n_session_3",
    "daily_rollup": "successes tokens_used",
    "fail_streaks": "fail_streak",
    "kpi_dashboard": "overfitting_count pending_review_count session_0 session_1 session_2 session_3",
    "stream_alerts": "loss_streak",
    "failure_convergence": "repeats_in_next",
    "intraday_counters": "n_hh n_ll",
}


def _bigint_counts(name: str, sql: str) -> str:
    wide = WIDE_COLUMNS.get(name)
    if wide is None:
        return sql
    rep = ", ".join(f'CAST("{c}" AS BIGINT) AS "{c}"' for c in wide.split())
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) hq"


def _shipped(fn: Query) -> Query:
    import functools

    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from barlake.session import ship_package
        ship_package(spark)
        return fn(spark, sf_dir)
    return run


def register(name: str, fn: Query, sql: str | None = None) -> None:
    QUERIES[name] = _shipped(fn)
    if sql is not None:
        ORACLES[name] = _bigint_counts(name, sql)


register("ma_cross_backtest_metrics", backtests.ma_cross_backtest_metrics,
         oracle.ma_cross_backtest_metrics())

register("minute_bars", barplans.minute_bars, oracle.minute_bars_q())
for _tf, _norm in [("5m", "5min"), ("45m", "45min"), ("60m", "60min"), ("17m", "17min"),
                   ("1d", "D"), ("1w", "W")]:
    register(f"resample_ohlc_{_tf}", barplans.resample(_tf), oracle.resample_q(_norm))
register("session_classify", barplans.session_classify, oracle.session_classify_q())
register("session_slice_day", barplans.session_slice_day, oracle.session_slice_day_q())
register("trading_sessions", barplans.trading_sessions, oracle.trading_sessions_q())
register("trading_day_assign", barplans.trading_day_assign, oracle.trading_day_assign_q())
register("next_trading_day", barplans.next_trading_day, oracle.next_trading_day_q())
register("bar_flags", barplans.bar_flags, oracle.bar_flags_q())
register("bar_gaps", barplans.bar_gaps, oracle.bar_gaps_q())
register("bar_quality_report", barplans.bar_quality_report, oracle.bar_quality_report_q())
register("symbol_summary", barplans.symbol_summary, oracle.symbol_summary_q())
register("bars_between", barplans.bars_between, oracle.bars_between_q())

register("ema_12", indicatorplans.ema_12, oracle.ema_12_q())
register("macd", indicatorplans.macd, oracle.macd_q())
register("rsi_wilder", indicatorplans.rsi, oracle.rsi_q())
register("atr", indicatorplans.atr, oracle.atr_q())
register("adx", indicatorplans.adx, oracle.adx_q())
register("bollinger_extremes", indicatorplans.bollinger, oracle.bollinger_q())
for _n, _fn in indicatorplans.SIGNAL_FNS.items():
    register(f"signals_{_n}", indicatorplans.signals(_fn), getattr(oracle, f"sig_{_n}_q")())
register("strategy_backtests", indicatorplans.strategy_backtests, oracle.strategy_backtests_q())

for _n in ["monthly_pnl", "monthly_matrix", "drawdown_series", "equity_daily", "signal_distribution",
           "trade_list", "trade_durations", "loss_streaks", "health_alerts"]:
    register(_n, getattr(reportplans, _n), getattr(oracle, f"{_n}_q")())

register("wfa_windows", wfaplans.wfa_windows, oracle.wfa_windows_q())
register("wfa_summary", wfaplans.wfa_summary, oracle.wfa_summary_q())
register("wfa_segment_metrics", wfaplans.wfa_segment_metrics, oracle.wfa_segment_metrics_q())

for _n in ["vector_topk", "failed_topk", "layered_search", "diversity_filter", "batch_diversity",
           "retrieval_eval", "retrieval_cases", "diversify_by_type", "collection_search",
           "fill_short_results"]:
    register(_n, getattr(retrievalplans, _n), getattr(oracle, f"{_n}_q")())
register("sample_examples", retrievalplans.sample_examples, oracle.sample_examples_q())

for _n in ["page_title_text", "page_dedup", "page_list_filter", "knowledge_context", "document_dedup",
           "script_lint", "script_checks", "json_payloads", "error_patterns", "top_failure_patterns",
           "frequent_patterns"]:
    register(_n, getattr(textplans, _n), getattr(oracle, f"{_n}_q")())

for _n in ["budget_status", "budget_breakdown", "daily_rollup", "running_spend", "fail_streaks",
           "provider_rates", "layer_pass_rates", "cost_quality", "step_failure_rates", "first_success",
           "weekly_quality", "metric_regression", "kpi_dashboard", "latest_trade_per_strategy",
           "list_strategies_page"]:
    register(_n, getattr(opsplans, _n), getattr(oracle, f"{_n}_q")())
register("recent_failures", opsplans.recent_failures, oracle.recent_failures_q())

for _n in ["constraint_check", "upsert_merge", "merge_bars", "clean_minute_bars", "collection_listing",
           "knowledge_upsert", "admission"]:
    register(_n, getattr(tableplans, _n), getattr(oracle, f"{_n}_q")())

for _n in ["stream_resample_5m", "stream_bars_5m", "stream_alerts", "stream_dedup_documents"]:
    register(_n, getattr(streamplans, _n), getattr(oracle, f"{_n}_q")())

for _n in ["rolling_sharpe", "pnl_histogram", "drawdown_episodes", "split_segments", "unpaired_labels",
           "report_table", "strategy_report", "validate_intents", "prompt_blocks", "embedding_texts",
           "failure_convergence"]:
    register(_n, getattr(extraplans, _n), getattr(oracle, f"{_n}_q")())
register("embed_documents", extraplans.embed_documents)

register("prior_day_features", intradayplans.prior_day_features, oracle.prior_day_features_q())
register("intraday_counters", intradayplans.intraday_counters, oracle.intraday_counters_q())
register("breakout_entries", intradayplans.breakout_entries, oracle.breakout_entries_q())

for _n in ["price_jumps", "recall_at_5", "mrr", "page_title", "page_text", "fenced_block"]:
    register(_n, getattr(extraplans, _n), getattr(oracle, f"{_n}_q")())
register("session_rules_daytrade_day", intradayplans.session_rules_daytrade_day,
         oracle.session_rules_daytrade_day_q())
register("find_similar_trend", retrievalplans.find_similar_trend, oracle.find_similar_trend_q())
register("stop_limits", retrievalplans.stop_limits, oracle.stop_limits_q())
register("fail_records", textplans.fail_records, oracle.fail_records_q())
register("critique_checks", textplans.critique_checks, oracle.critique_checks_q())
register("knowledge_listing", textplans.knowledge_listing, oracle.knowledge_listing_q())
register("collection_upsert", tableplans.collection_upsert, oracle.collection_upsert_q())
register("minute_table", barplans.minute_table, oracle.minute_table_q())
for _n in ["bar_files", "bar_file_range"]:
    register(_n, getattr(barplans, _n), getattr(oracle, f"{_n}_q")())
for _n in ["retrieve_bundle", "recall_keyword", "mrr_keyword"]:
    register(_n, getattr(retrievalplans, _n), getattr(oracle, f"{_n}_q")())
register("trade_list_open", reportplans.trade_list_open, oracle.trade_list_open_q())
for _n in ["session_trades", "session_backtest"]:
    register(_n, getattr(intradayplans, _n), getattr(oracle, f"{_n}_q")())
register("approx_topk", retrievalplans.approx_topk)
register("approx_recall", retrievalplans.approx_recall, oracle.approx_recall_q())
for _n in ["stored_upsert", "stored_upsert_report", "minute_table_range", "collection_rejects", "collection_counts"]:
    register(_n, getattr(storedplans, _n), getattr(oracle, f"{_n}_q")())
for _n in ["holding_time_buckets", "holding_time_quantiles"]:
    register(_n, getattr(reportplans, _n), getattr(oracle, f"{_n}_q")())
for _n in ["report_numbers", "report_files", "strategy_library", "strategy_texts", "library_index"]:
    register(_n, getattr(libraryplans, _n), getattr(oracle, f"{_n}_q")())
for _n in ["faulty_price_jumps", "faulty_bar_report", "faulty_bars_cleaned", "signals_trend_breakout_prior", "pandas_strategy",
           "aligned_signals", "metric_runs", "knowledge_context_tagged", "script_summary", "first_success_cascade",
           "kpi_overview", "kpi_distribution", "find_similar_records", "sample_examples_by_type", "recall_keyword_query"]:
    register(_n, getattr(moreplans, _n), getattr(oracle, f"{_n}_q")())
