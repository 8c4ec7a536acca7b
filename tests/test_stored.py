"""Stored tables: touched partitions, rejects, pruned reads; one-plan bar files; library folders."""
import os

from pyspark.sql import functions as F

from barlake.sources import bars_csv as bc
from barlake.sources import fixtures as fx
from barlake.sources import stored as st

SCHEMA = "k long, p int, v string"


def test_upsert_rewrites_only_touched_partitions(spark):
    path = st.new_table(spark, "t")
    old = spark.createDataFrame([(i, i % 4, f"old{i}") for i in range(40)] + [(100, None, "none")], SCHEMA)
    st.write_table(old, path, "p")
    before = {r["p"]: r["files"] for r in st.partition_files(spark, path, old.schema, "p").collect()}
    batch = spark.createDataFrame([(1, 1, "a", 1), (1, 1, "b", 2), (41, 1, "new", 1), (None, 2, "bad", 1), (70, 7, "p7", 1)],
                                  "k long, p int, v string, n int")
    check = lambda x: (x.where("k IS NOT NULL"), x.where("k IS NULL").withColumn("reason", F.lit("no key")))
    st.stored_upsert(batch, path, ["k"], "p", ["n"], check, f"{path}-bad")
    rows = {r["k"]: (r["p"], r["v"]) for r in st.read_table(spark, path, old.schema).collect()}
    assert len(rows) == 43 and rows[1] == (1, "b") and rows[41] == (1, "new") and rows[5] == (1, "old5") and rows[70] == (7, "p7")
    after = {r["p"]: r["files"] for r in st.partition_files(spark, path, old.schema, "p").collect()}
    assert {p for p in after if after[p] != before.get(p)} == {1, 7}
    assert [r["reason"] for r in spark.read.parquet(f"{path}-bad").collect()] == ["no key"]
    again = spark.createDataFrame([(100, None, "other", 1)], "k long, p int, v string, n int")
    st.stored_upsert(again, path, ["k"], "p", ["n"])
    assert st.read_table(spark, path, old.schema).where("p IS NULL").first()["v"] == "other"


def test_clear(spark):
    path = st.new_table(spark, "t")
    df = spark.createDataFrame([(i, i % 3, "x" if i < 9 else "y") for i in range(12)] + [(99, 5, "x")], SCHEMA)
    st.write_table(df, path, "p")
    assert st.clear_table(spark, path, df.schema, "p", F.col("v") == "x") == 10
    assert sorted(r["k"] for r in st.read_table(spark, path, df.schema).collect()) == [9, 10, 11]
    assert st.clear_table(spark, path, df.schema, "p") == 3
    assert st.read_table(spark, path, df.schema).count() == 0


def test_range_read_is_pruned(spark):
    table = st.write_minute_table(fx.minute_bars(spark, "/root/testdata/sf0.001"), st.new_table(spark, "m"))
    x = st.trading_days_between(table, "2024-01-25", "2024-01-28", "click")
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(trading_day_month" in plan and "PushedFilters: [IsNotNull(trading_day)" in plan
    assert x.count() > 0


def test_a_thousand_files_of_mixed_layouts(spark, tmp_path):
    want = {}
    for i in range(1000):
        kind = i % 5
        name, price = f"S{i:04d}", 100.0 + i
        ohlc = f"{price},{price + 2},{price - 1},{price + 1}"
        text = [f"20240105,901,{ohlc}\n20240105,1330,{ohlc}\n",
                f"Date,Time,Open,High,Low,Close\n2024/01/05,09:01:00,{ohlc}\n2024/01/05,13:30:00,{ohlc}\n",
                f'"timestamp","close","open","high","low"\n2024-01-05 09:01:00,{price + 1},{price},{price + 2},{price - 1}\n\n',
                f"Date,Open,High,Low,Close,Volume\n2024-01-05,{ohlc},7\nbroken line\n",
                "no bars\nin this file\n"][kind]
        (tmp_path / f"{name}.{'txt' if kind in (0, 4) else 'csv'}").write_text(text)
        want[name] = [2, 2, 1, 1, 0][kind]
    bars, rep = bc.read_bars_dir(spark, str(tmp_path))
    got = {r["symbol"]: r for r in bars.groupBy("symbol").agg(F.count("*").alias("n"), F.max("close").alias("close"), F.max("open").alias("o")).collect()}
    assert {s: r["n"] for s, r in got.items()} == {s: n for s, n in want.items() if n}
    assert all(r["o"] == 100.0 + int(s[1:]) and r["close"] == r["o"] + 1 for s, r in got.items())
    bad = {os.path.basename(r["file"])[:5] for r in rep.where("rejected").collect()}
    assert bad == {s for s, n in want.items() if not n}
    assert rep.where("NOT rejected AND bad_rows = 1").count() == 200


def test_library_pairs_inside_a_folder(spark, tmp_path):
    meta = "name: A\nholding_type: swing\ncategory: trend\ntimeframe: 1d\ndirection: both\ndescription: {}\n"
    for folder, files in {"one": {"A.yaml": meta.format("first"), "A.ELS": "code one"}, "two": {"A.yaml": meta.format("second")},
                          "three": {"A.ELS": "code three"}}.items():
        (tmp_path / folder).mkdir()
        for name, text in files.items():
            (tmp_path / folder / name).write_text(text)
    lib, rej = bc.load_strategy_library(spark, str(tmp_path))
    assert [(r["folder"], r["description"], r["code"]) for r in lib.collect()] == [("one", "first", "code one")]
    assert [(r["folder"], r["reject_reason"]) for r in rej.collect()] == [("two", "no script file")]
