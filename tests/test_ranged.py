"""Numbering by sampled ranges: one key in one hour over several tasks, same numbers; holding times."""
import datetime as dt

from pyspark.sql import functions as F

from barlake.operators import metrics as mt
from barlake.operators import sequence as sq
from barlake.plans import reportplans as rp

SF = "/root/testdata/sf0.001"


def test_a_hot_hour_runs_in_several_tasks(spark):
    t0 = dt.datetime(2024, 1, 1, 9)
    rows = [("hot", t0 + dt.timedelta(seconds=i % 3600), i) for i in range(4000)] + [
        (None if i % 4 == 0 else f"k{i % 3}", None if i % 50 == 0 else t0 + dt.timedelta(hours=i), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, i long")
    x = sq.ranged_ordinal(df, ["k"], ["ts", "i"], parts=16)
    want = {}
    for k, ts, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or t0, r[2])):
        want[(k, i)] = sum(1 for kk, _ in want if kk == k) if k != "hot" else len([1 for kk, _ in want if kk == "hot"])
    assert {(r.k, r.i): r._ord for r in x.collect()} == want
    sorted_files = [f for f in x.inputFiles() if "_pos" in spark.read.parquet(f).columns]
    hot = [spark.read.parquet(f).where("k = 'hot'").count() for f in sorted_files]
    assert sum(hot) == 4000 and max(hot) < 1000


def test_streaks_are_the_same_in_blocks(spark):
    a = sorted(map(tuple, rp.loss_streaks(spark, SF).collect()))
    assert a == sorted(map(tuple, rp.loss_streaks(spark, SF, block=64).collect()))


def test_sketch_ranks_on_many_values(spark):
    df = spark.range(50_000).selectExpr("id % 3 AS k", "(id * 7919) % 100003 AS minutes")
    q = {(r.k, r.quantile): r.value for r in mt.holding_time_quantiles(df, ["k"], [0.1, 0.5, 0.9]).collect()}
    assert len(q) == 9
    for (k, p), value in q.items():
        rank = df.where(F.col("k") == k).agg(F.avg((F.col("minutes") <= value).cast("double"))).first()[0]
        assert abs(rank - p) <= mt.SKETCH_ERROR
