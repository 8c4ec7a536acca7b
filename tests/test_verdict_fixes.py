"""Cases of the last review: null keys in blocked sequences, keep-last upserts,
composite foreign keys, script comments, summaries, failure records."""
import datetime as dt

from pyspark.sql import functions as F

from barlake.operators import opsanalytics as oa
from barlake.operators import sequence as sq
from barlake.operators import textops as tx
from barlake.plans import tableplans
from barlake.sources import tables as tb


def _rows(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(None if i % 3 == 0 else f"k{i % 3}", None if i % 10 == 9 else base + dt.timedelta(hours=7 * i), i, float(i % 5)) for i in range(60)]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, i long, v double")


def test_blocks_keep_rows_with_null_keys_and_times(spark):
    got = {}
    for block in (4, 65_536):
        x, bl = sq.sequence(_rows(spark), ["k"], ["ts", "i"], block=block)
        out = sq.scan(x, ["k"], {"s": (sq.Sum(), F.col("v"))}, block=bl, checkpoint=False)
        got[block] = sorted((str(r.k), r.i, r._ord, r.s) for r in out.collect())
    assert len(got[4]) == 60 and got[4] == got[65_536]


def test_appended_data_is_measured_again(spark):
    df = _rows(spark).where("k = 'k1'")
    for n in (1, 4):
        x = df
        for j in range(1, n):
            x = x.unionByName(df.withColumn("i", F.col("i") + 1000 * j))
        y, bl = sq.sequence(x, ["k"], ["ts", "i"], block=8)
        assert sq.scan(y, ["k"], {"s": (sq.Sum(), F.col("v"))}, block=bl, checkpoint=False).count() == 20 * n


def test_upsert_keeps_the_last_of_equal_new_keys(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, v string, n long")
    new = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (3, "z", 1)], "id long, v string, n long")
    got = sorted(map(tuple, tb.upsert(old, new, ["id"], ["n"]).collect()))
    assert got == [(1, "y", 2), (2, "b", 0), (3, "z", 1)]


def test_composite_reference_with_a_null_is_none(spark):
    parent = spark.createDataFrame([(1, 1)], "a long, b long")
    child = spark.createDataFrame([(1, None), (1, 1), (2, 2), (None, 3)], "a long, b long")
    got = tb.check_constraints(child, "c", not_null=["a", "b"], fks=[(["a", "b"], parent, ["a", "b"])]).collect()
    assert sorted((r.kind, r.constraint, r.key, r.n_rows) for r in got) == [
        ("foreign_key", "a,b", "2|2", 1), ("not_null", "a", None, 1), ("not_null", "b", None, 1)]


def test_only_foreign_comments_go(spark):
    code = "a = 1 // plain\n  // nur ü hier\nb = 2 // mit é\nbuy {ñ} now\nkeep {this}\n{open é\nx {ok} // ß"
    df = spark.createDataFrame([(code,), ("",), ("one\n",)], "c string")
    got = [r[0] for r in df.select(tx.strip_non_ascii_comments("c")).collect()]
    assert got == ["a = 1 // plain\r\nb = 2\r\nbuy  now\r\nkeep {this}\r\n{open é\r\nx {ok}", "", "one"]


def test_summary_ends_with_the_method(spark):
    code = "class A:\n    def generate_signals(self):\n        x = 1\n\n        return x\n    def other(self):\n        pass"
    long = "def generate_signals():\n" + "y = 1\n" * 400
    df = spark.createDataFrame([(code,), ("no method",), (long,)], "c string")
    whole = [r[0] for r in df.select(tx.summarise_code("c")).collect()]
    assert whole[0] == "def generate_signals(self): |         x = 1 |         return x" and whole[1] == tx.NO_SUMMARY
    assert whole[2].count("y = 1") == 400
    cut = df.select(tx.summarise_code("c", None, 300)).collect()[2][0]
    assert len(cut) == 303 and cut.endswith("...")


def test_page_text_is_whole(spark):
    df = spark.createDataFrame([("<p>" + "w " * 9000 + "end</p>",)], "html string")
    assert df.select(tx.extract_text("html")).first()[0].endswith("end")
    assert len(df.select(tx.extract_text("html", 6000)).first()[0]) == 6000


def test_failure_reasons_in_order(spark):
    gate = {"min_trades": 80, "sharpe_min": 1.2, "max_drawdown_max": 0.35, "profit_factor_min": 1.3}
    rows = [("compile", 1, 0.0, 1.0, 0.0), ("other", 1, 0.0, 1.0, 0.0), (None, 1, 0.0, 1.0, 0.0), (None, 90, 1.0, 1.0, 0.0),
            (None, 90, 1.5, 0.4, 2.0), (None, 90, 1.5, 0.1, 1.2), (None, 90, 1.5, 0.1, 1.3)]
    df = spark.createDataFrame(rows, "step string, total_trades long, sharpe double, max_drawdown double, profit_factor double")
    got = [r[0] for r in df.select(oa.classify_failure(df, gate, F.col("step"))).collect()]
    assert got == ["mc_compile_error", "unknown", "insufficient_trades", "low_sharpe", "high_drawdown", "low_profit_factor", None]


def test_overfitted_strategies_are_admitted_and_queued(spark):
    got = tableplans.admission(spark, "/root/testdata/sf0.01")
    assert got.where("admitted and overfit and review_queue").count() > 0
    assert got.where("admitted and not overfit and not review_queue").count() > 0
    assert got.where("review_queue and not admitted").count() == 0


def test_constraints_of_a_large_table(spark, monkeypatch):
    """Keys of a large table are dealt to as many tasks as its rows ask for, with the same report."""
    rows = [(i % 900, i % 7) for i in range(1000)] + [(None, 1), (None, 1)]
    df = spark.createDataFrame(rows, "a long, b long")
    parent = spark.range(5, 800).selectExpr("id as k").unionByName(spark.range(5, 50).selectExpr("id as k"))
    report = lambda x: sorted((r.constraint, r.kind, r.key or "", r.n_rows) for r in x.collect())
    check = lambda: tb.check_constraints(df, "t", pk=["a", "b"], unique=[["a"]], fks=[(["a"], parent, ["k"])])
    small = report(check())
    assert [x for x in small if x[1] == "foreign_key"] == sorted(("a", "foreign_key", str(i), 2 if i < 100 else 1) for i in [*range(5), *range(800, 900)])
    monkeypatch.setattr(tb, "KEYS_PER_TASK", 100)
    large = check()
    assert report(large) == small and len(small) > 200
    plan = large._jdf.queryExecution().optimizedPlan().toString()
    assert sum("RepartitionByExpression" in x and x.endswith(", 11") for x in plan.splitlines()) == 4
