import datetime as dt
import json
import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from barlake.operators import backtest as bt
from barlake.operators import embedding as em
from barlake.operators import retrieval as rv
from barlake.operators import signals as sg
from barlake.operators import textops as tx
from barlake.sources import tables as tb


def test_approx_topk_recall(spark):
    rng = np.random.default_rng(11)
    vecs = rng.normal(size=(80, 6))
    df = spark.createDataFrame([(i, vecs[i].tolist()) for i in range(80)], "id long, vec array<double>")
    q = df.selectExpr("id as qid", "vec as qvec")
    exact = {(r.qid, r.id) for r in rv.vector_topk(q, df, 3, exclude_self=True).collect()}
    approx = {(r.qid, r.id) for r in em.approx_topk(q, df, 3, bucket_length=2.0, tables=6, max_distance=1.5).collect()}
    assert len(exact & approx) / len(exact) > 0.5        # LSH recall reported against the exact path


def test_critique_passed(spark):
    ok = {"syntax_confidence": 0.8, "logic_match": True, "has_stop_loss": True, "has_force_close": True,
          "uses_forbidden_keywords": [], "overall_quality": "good"}
    bad = dict(ok, uses_forbidden_keywords=["Volume"])
    df = spark.createDataFrame([(json.dumps(ok),), (json.dumps(bad),)], "j string")
    assert [r[0] for r in df.select(tx.critique_passed(F.col("j"))).collect()] == [True, False]


def test_list_strategies_and_session_rules(spark):
    names = {r.name for r in sg.list_strategies(spark).collect()}
    assert {"MA_Cross", "RSI_Reversal", "TrendFilteredEMA"} <= names
    df = spark.createDataFrame([(dt.datetime(2020, 1, 2, 13, 24), 1), (dt.datetime(2020, 1, 2, 13, 30), 1),
                                (dt.datetime(2020, 1, 2, 13, 39), -1)], "ts timestamp_ntz, signal int")
    out = bt.apply_rules_and_force_close(df, "daytrade_day").orderBy("ts").collect()
    assert [r.entry_signal for r in out] == [1, 0, 0] and [r.exit_marker for r in out] == [False, False, True]


def test_flat_slippage_and_align(spark):
    df = spark.createDataFrame([(100.0, 110.0, 1), (100.0, 90.0, -1)], "e double, x double, d int")
    got = [r[0] for r in df.select(bt.flat_slippage_pnl(F.col("e"), F.col("x"), F.col("d"))).collect()]
    assert got == [(10 - 4) * 200.0, (10 - 4) * 200.0]
    bars = spark.createDataFrame([("S", 1, 5.0), ("S", 2, 6.0)], "symbol string, ts int, close double")
    sigs = spark.createDataFrame([("S", 2, 1)], "symbol string, ts int, signal int")
    assert bt.align_signals(bars, sigs).first().close == 6.0


def test_collection_upsert_dims_and_remove(spark):
    old = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    new = spark.createDataFrame([(2, [0.5, 0.5]), (3, [1.0, 1.0, 1.0])], "id long, v array<double>")
    ok, rej = rv.check_dim(new, "v", 2)
    res = {r.id: r.v for r in tb.upsert(old, ok, ["id"]).collect()}
    assert res == {1: [1.0, 0.0], 2: [0.5, 0.5]} and rej.count() == 1
    keys = spark.createDataFrame([(1,)], "id long")
    assert [r.id for r in tb.remove_by_key(old, keys, ["id"]).collect()] == [2]


def test_index_library_composition(spark):
    from barlake.sources import bars_csv as bc
    root = tempfile.mkdtemp(prefix="idx-")
    os.makedirs(f"{root}/Swing")
    with open(f"{root}/Swing/S1.yaml", "w") as f:
        f.write("name: S1\nholding_type: swing\ncategory: trend\ntimeframe: 1d\ndirection: long\ndescription: ride trends\n")
    with open(f"{root}/Swing/S1.ELS", "w") as f:
        f.write("inputs: n(20);")
    lib, _ = bc.load_strategy_library(spark, root)
    texts = lib.select("stem", F.concat_ws(" | ", "name", "category", "timeframe", "description").alias("t"))
    vecs = em.hashing_encoder(texts, "t", "vec", 64)
    idx = tb.upsert(spark.createDataFrame([], vecs.schema), vecs, ["stem"])
    r = idx.first()
    assert r.stem == "S1" and len(r.vec) == 64 and abs(sum(v * v for v in r.vec) - 1.0) < 1e-5
