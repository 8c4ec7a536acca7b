"""Named plans over files: report files, the strategy library and its index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.operators import embedding as em
from barlake.operators import textops as tx
from barlake.plans.common import round_doubles
from barlake.sources import bars_csv as bc
from barlake.sources import files as fl
from barlake.sources import fixtures as fx
from barlake.sources import stored as st


def report_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K11 on every line item's key in one of nine spellings."""
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    t = k.cast("string")
    three = F.lpad((k % 1000).cast("string"), 3, "0")
    kinds = [F.concat(F.lit("$1,"), three), F.concat(F.lit("($2,"), three, F.lit(")")), F.concat(F.lit("-"), t, F.lit(".5%")),
             F.lit("—"), F.lit("N/A"), F.concat(F.lit("-$"), t), F.concat(F.lit('"'), t, F.lit('"')),
             F.concat(t, F.lit(" 000")), F.concat(F.lit("("), t, F.lit("%)"))]
    raw = F.element_at(F.array(*kinds), (k % 9 + 1).cast("int"))
    x = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"))
    return x.withColumn("value", tx.parse_report_number(F.col("raw")))


def _report_rows(spark, sf_dir) -> DataFrame:
    """A report per supplier: English labels in UTF-8 with and without a mark, Chinese
    ones in cp950; some without a Sharpe ratio, a drawdown percentage or a win rate."""
    i = F.col("s_suppkey")
    comma = lambda c: F.format_number(c, 0)
    profit = comma((i * 12345) % 2_000_000)
    profit = F.when(i % 5 == 0, F.concat(F.lit('"($'), profit, F.lit(')"'))).otherwise(F.concat(F.lit('"$'), profit, F.lit('"')))
    chinese = i % 3 == 2
    label = lambda en, zh: F.when(chinese, zh).otherwise(en)

    def line(name, value):
        return F.concat(name, F.lit(","), value)

    lines = F.array(
        line(label("Total Net Profit", "總淨利"), profit),
        line(label("Profit Factor", "獲利因子"), F.format_string("%d.%02d", i % 4, i % 100)),
        F.when(i % 4 != 1, line(label("Max. Drawdown %", "最大回撤%"), F.format_string("-%d.5%%", i % 60))),
        line(label("Max. Drawdown", "最大回撤"), F.concat(F.lit('"($'), comma(i * 100 + 1000), F.lit(')"'))),
        line(label("Total Number of Trades", "交易次數"), (i % 91 + 60).cast("string")),
        F.when(i % 2 == 0, line(label("Percent Profitable", "勝率"), F.format_string("%d.25%%", i % 90))),
        F.when(i % 2 == 1, line(label("Winning Trades", "獲利交易"), (i % 50 + 1).cast("string"))),
        line(label("Sharpe Ratio", "夏普指標"), F.when(i % 7 == 0, "—").otherwise(F.format_string("%d.%d", i % 3, i % 10))))
    text = F.concat(F.array_join(F.filter(lines, lambda l: l.isNotNull()), "\n"), F.lit("\n"))
    return fx.table(spark, sf_dir, "supplier").select(
        F.format_string("report-%06d.csv", i).alias("path"), text.alias("content"),
        F.when(chinese, "cp950").when(i % 3 == 0, "utf-8-sig").otherwise("utf-8").alias("encoding"))


def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of every report file, read back from three encodings."""
    folder = st.new_table(spark, "reports")
    fl.write_files(_report_rows(spark, sf_dir), folder)
    r = bc.parse_report_files(spark, f"{folder}/*.csv")
    out = r.select(F.regexp_extract("file", r"report-(\d+)\.csv$", 1).cast("long").alias("strategy"), "total_net_profit",
                   "profit_factor", "max_drawdown_pct", "max_drawdown_abs", "total_trades", "win_rate", "sharpe_ratio", "missing")
    return round_doubles(out)


def _library_files(spark, sf_dir) -> DataFrame:
    """Metadata and script of a strategy per supplier, two folders with the same stems;
    some lack a field, have an unknown holding type or category, or no script."""
    s = fx.table(spark, sf_dir, "supplier").withColumn("folder", F.explode(F.array(F.lit("Daytrade"), F.lit("Swing"))))
    i, day = F.col("s_suppkey"), F.col("folder") == "Daytrade"
    stem = F.format_string("S%05d", i)
    holding = F.when(i % 11 == 0, "scalp").when(day, "DayTrade").otherwise("swing")
    category = F.when(i % 6 == 5, "Momentum").otherwise(F.element_at(F.array(*map(F.lit, bc.CATEGORIES)), (i % 5 + 1).cast("int")))
    meta = F.concat(F.lit("name: "), stem, F.lit("\nholding_type: "), holding, F.lit("\ncategory: "), category,
                    F.lit("\ntimeframe: 5min\n"), F.when(i % 9 == 0, "").otherwise("direction: both\n"),
                    F.lit('description: "'), F.col("s_name"), F.lit(" in "), F.col("folder"), F.lit('"\nrisk_features: [stop, flat]\nnotes: n'),
                    i.cast("string"), F.lit("\n"))
    code = F.concat(F.lit("Inputs: n("), i.cast("string"), F.lit("); { 策略 }\nBuy Next Bar at Market;\n"))
    path = F.concat("folder", F.lit("/"), stem)
    yaml = s.select(F.concat(path, F.lit(".yaml")).alias("path"), meta.alias("content"), F.lit("utf-8").alias("encoding"))
    script = s.where(~((i % 13 == 0) & day)).select(F.concat(path, F.lit(".ELS")).alias("path"), code.alias("content"),
                                                    F.when(i % 2 == 0, "cp950").otherwise("utf-8").alias("encoding"))
    return yaml.unionByName(script)


def _library(spark, sf_dir) -> str:
    folder = st.new_table(spark, "library")
    fl.write_files(_library_files(spark, sf_dir), folder)
    return folder


def strategy_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17 + C13: entries of the library folder and rejects with their reason."""
    ok, rejects = bc.load_strategy_library(spark, _library(spark, sf_dir))
    cols = ["folder", "stem"]
    a = ok.select(*cols, "holding_type", "category", "unknown_category", F.array_join("risk_features", ",").alias("risk_features"),
                  F.length("code").alias("code_chars"), F.contains("code", F.lit("策略")).alias("code_decoded"),
                  F.lit(None).cast("string").alias("reject_reason"))
    return a.unionByName(rejects, allowMissingColumns=True)


def strategy_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three embedding texts of every library entry, with the reference's limits."""
    ok, _ = bc.load_strategy_library(spark, _library(spark, sf_dir))
    return em.embedding_parts(ok, 200, 500).select("folder", "stem", "metadata_text", "semantic_text",
                                                   F.sha2("code_text", 256).alias("code_hash"))


def library_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library indexed into a stored collection: a dry run writes nothing, then
    all entries, then the entries of one folder again (an upsert adds none)."""
    root, path = _library(spark, sf_dir), st.new_table(spark, "index")
    runs = [("dry run", None, True), ("rebuild", None, False), ("upsert", "Swing", False)]
    out = None
    for name, folder, dry in runs:
        n = em.index_library(spark, root, path, folder=folder, dry_run=dry)
        stored = st.read_table(spark, path, em.INDEX_SCHEMA)
        unit = F.abs(F.aggregate("semantic_vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x) - 1) < 1e-5
        one = st.materialize(stored.agg(F.lit(name).alias("run"), F.lit(n).cast("long").alias("n_entries"),
                                        F.count(F.lit(1)).alias("n_stored"), F.count_if(~unit).alias("n_not_unit"),
                                        F.count_if(F.col("folder") == "Swing").alias("n_swing")))
        out = one if out is None else out.unionByName(one)
    return out
