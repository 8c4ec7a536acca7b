"""Edges of the knowledge context, declarations, cascades, category samples, records and file writing."""
import os

from pyspark.sql import functions as F

from barlake.operators import embedding as em
from barlake.operators import opsanalytics as oa
from barlake.operators import retrieval as rv
from barlake.operators import textops as tx
from barlake.plans import moreplans as mp
from barlake.sources import files as fl

SF = "/root/testdata/sf0.01"


def test_knowledge_context(spark):
    rows = [(i, f"u{i}", None if i == 2 else f"t{i}", tags, content, ok) for i, (tags, content, ok) in enumerate(
        [("ABC,x", "one", True), (None, "two", None), ("abc", "x" * 10, None), ("abc", "no", False), ("abc", "", True), ("zabcz", "six", True)])]
    df = spark.createDataFrame(rows, "id long, url string, title string, tags string, content string, fetch_ok boolean")
    got = {r.tag_filter: (r.n_pages, r.context) for r in tx.knowledge_context(df, ["aBc", "", "none"], 2, 4).collect()}
    head = tx.CONTEXT_HEADING + "\n"
    assert got["none"] == (0, "")
    assert got["aBc"] == (2, head + "### [t0](u0)\n標籤：ABC,x\none\n" + "\n" + "### [u2](u2)\n標籤：abc\nxxxx\n")
    assert got[""][1].startswith(head + "### [t0](u0)") and "標籤：無\ntwo" in got[""][1]


def test_missing_declarations(spark):
    df = spark.createDataFrame([("INPUTS variables buy SELL",), ("buy",), ("",)], "code string")
    assert [r[0] for r in df.select(tx.missing_declarations("code")).collect()] == [
        "", "inputs 宣告, variables 宣告, Sell Short 進場指令", "inputs 宣告, variables 宣告, Buy 進場指令, Sell Short 進場指令"]


def test_cascade_order(spark):
    rows = [(1, "b", 5, True, "2024-01-01"), (1, "a", 6, False, "2024-01-02"), (1, "x", 4, True, "2024-01-01"),
            (2, "a", 7, False, "2024-01-01"), (2, "b", 8, False, "2024-01-01"), (3, "x", 9, True, "2024-01-01"), (3, "b", 10, True, "2024-01-05")]
    df = spark.createDataFrame(rows, "request long, provider string, call_id long, success boolean, created_at string")
    got = {r.request: (r.succeeded, r.provider, r.call_id) for r in oa.first_success_cascade(df, ["a", "b"]).collect()}
    assert got == {1: (True, "b", 5), 2: (False, "b", 8), 3: (True, "b", 10)}


def test_examples_for_every_category(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(["a"] * 7 + ["b"] * 2 + [None])], "name long, cat string")
    rows = rv.sample_examples_by_category(df, "cat", 3).orderBy("slot").collect()
    by = {t: [r.cat for r in rows if r.target == t] for t in ("a", "b", None)}
    assert by["a"] == ["a"] * 3 and by["b"][:2] == ["b"] * 2 and len(by["b"]) == 3 and by[None][0] is None


def test_signals_and_recall_differ(spark):
    assert mp.signals_trend_breakout_prior(spark, SF).where("signal <> 0").count() > 0
    r = {x.kind: x.recall_at_5 for x in mp.recall_keyword_query(spark, SF).collect()}
    # the lower-case keyword is in the query text, the capitalised one is not
    assert r[3] == 1.0 and r[8] == 0.0


def test_query_text_leaves_out_empty_fields(spark):
    df = spark.createDataFrame([("trend", None, "", "both", "x")], "a string, b string, c string, d string, e string")
    assert df.select(rv.query_text(*map(F.col, "abcde"))).first()[0] == "Category: trend\nDirection: both\nRequirements: x"


def test_files_and_texts(spark, tmp_path):
    df = spark.createDataFrame([("a/b.txt", "策略", "cp950"), ("c.txt", "é", "utf-8-sig")], "path string, content string, encoding string")
    assert fl.write_files(df, str(tmp_path)) == 2 == fl.write_files(df, f"file:{tmp_path}")
    assert (tmp_path / "a" / "b.txt").read_bytes().decode("cp950") == "策略" and os.path.getsize(tmp_path / "c.txt") == 5
    lib = spark.createDataFrame([("swing", "trend", "5m", "both", "d" * 600, "n", "code")],
                                "holding_type string, category string, timeframe string, direction string, description string, notes string, code string")
    whole, cut = em.embedding_parts(lib).first(), em.embedding_parts(lib, 200, 500).first()
    assert whole.semantic_text == "d" * 600 + "\n備註: n" and len(cut.semantic_text) == 500 and cut.code_text == "code"
    assert whole.metadata_text == "類型: swing trend\n時間框架: 5m\n方向: both\n概要: " + "d" * 50
