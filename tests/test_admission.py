"""Two-stage gate, admission on real rows, results stored by content."""
from pyspark.sql import functions as F

from barlake.operators import metrics as mt
from barlake.operators import opsanalytics as oa
from barlake.plans import tableplans as tp
from barlake.plans import wfaplans as wp
from barlake.session import content_key

SF = "/root/testdata/sf0.01"


def test_gate_two_stage(spark):
    rows = [(1, 2.0, 0.1, 2.5, 120, 0.7), (2, 2.0, 0.1, 2.5, 120, 0.5), (3, 1.3, 0.3, 1.2, 90, 0.9), (4, 1.0, 0.1, 2.5, 120, 0.9),
            (5, 2.0, 0.1, 2.5, 120, None), (6, None, 0.1, 2.5, 120, 0.8), (7, 2.0, 0.2, 2.0, 100, 0.6), (8, 2.0, 0.21, 2.0, 100, 0.6)]
    df = spark.createDataFrame(rows, "i int, sharpe double, max_drawdown double, profit_factor double, total_trades long, ratio double")
    got = {r.i: (r.screen_passed, r.strict_passed) for r in mt.gate_two_stage(df).collect()}
    # the strict gate asks 1.5, 20 %, 2.0, 100 trades and a ratio of 0.6; a null Sharpe fails no comparison
    assert got == {1: (True, True), 2: (True, False), 3: (True, False), 4: (False, False), 5: (True, False),
                   6: (True, True), 7: (True, True), 8: (True, False)}


def test_admission_flags_differ(spark):
    rows = tp.admission(spark, SF).collect()
    for flag in ("screen_passed", "strict_passed", "overfit", "admitted", "review_queue"):
        assert {r[flag] for r in rows} == {True, False}, flag
    assert len({r.failure_reason for r in rows}) >= 3
    assert all(r.screen_passed or not r.strict_passed for r in rows)


def test_failed_steps_come_before_measures(spark):
    steps = ["validation", "compile", "budget", "timeout", "download", None]
    df = spark.createDataFrame([(s, 10 * i, 0.1 * i, 0.5, 1.0) for i, s in enumerate(steps)],
                               "step string, total_trades long, sharpe double, max_drawdown double, profit_factor double")
    got = [r[0] for r in df.select(oa.classify_failure(df, mt.ADMISSION_GATE, F.col("step"))).collect()]
    assert got == ["el_syntax_error", "mc_compile_error", "budget_exhausted", "llm_timeout", "unknown", "insufficient_trades"]


def test_results_are_stored_by_content(spark):
    df = spark.range(100).selectExpr("id", "id % 7 AS v", "CASE WHEN id % 5 = 0 THEN NULL ELSE id END AS n")
    key = content_key(df, {"a": 1})
    assert key == content_key(df.orderBy(F.rand(1)).repartition(7), {"a": 1})
    assert key != content_key(df, {"a": 2}) and key != content_key(df.limit(99), {"a": 1})
    assert key != content_key(df.withColumn("v", F.when(F.col("id") == 3, 0).otherwise(F.col("v"))), {"a": 1})
    a, _ = wp.segment_metrics(spark, SF)
    b, _ = wp.segment_metrics(spark, SF)
    assert a.inputFiles() == b.inputFiles() != wp.segment_metrics(spark, SF, tp.ADMISSION_CONTRACT)[0].inputFiles()
