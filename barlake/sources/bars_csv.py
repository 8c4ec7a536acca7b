"""Bar files and library folders.

Readers are plain ``spark.read`` calls with explicit schemas; the file a row
came from is ``_metadata.file_path``, so per-file decisions (format, rejects,
symbol from the file stem) are ``groupBy(file)`` aggregates, never a driver
loop over files.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.sources.files import parsed_files

OHLC = ["open", "high", "low", "close"]


def _file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def detect_bar_format(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """A1: per file 'headed' when the first token of a line (quotes stripped,
    any case) is ``date`` or ``timestamp``, else 'compact'.  A header can only
    be line 1, so no line order is needed."""
    t = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))
    tok = F.lower(F.regexp_replace(F.split(F.trim("value"), ",")[0], "[\"']", ""))
    hdr = F.when(tok.isin("date", "timestamp"),
                 F.lower(F.regexp_replace(F.trim("value"), r"[\"'\s]", "")))
    g = t.groupBy("file").agg(F.max(tok.isin("date", "timestamp").cast("int")).alias("_h"),
                              F.max(F.when(tok == "timestamp", 1).otherwise(0)).alias("_ts"),
                              F.max(hdr).alias("header"))
    fmt = F.when(F.col("_h") == 1, F.lit("headed")).otherwise(F.lit("compact"))
    return g.select("file", fmt.alias("format"), (F.col("_ts") == 1).alias("single_timestamp"), "header")


def read_compact_bars(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """A2: headerless ``YYYYMMDD,HHMM,o,h,l,c``; the time is an unpadded
    integer (901 → 09:01); bad numbers become null."""
    sch = "d string, t string, o string, h string, l string, c string"
    x = spark.read.schema(sch).csv(paths, header=False)
    ts = F.try_to_timestamp(F.concat(F.trim("d"), F.lpad(F.trim("t"), 4, "0")), F.lit("yyyyMMddHHmm"))
    return x.select(F.col("_metadata.file_path").alias("file"), ts.cast("timestamp_ntz").alias("ts"),
                    *[F.trim(c).try_cast("double").alias(n) for c, n in zip("ohlc", OHLC)])


# Accepted date/time spellings of headed files
DATE_FORMATS = ["yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd HH:mm",
                "yyyy/MM/dd", "yyyy-MM-dd"]


def read_headed_bars(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """A3: header with ``Date[,Time]`` or a single ``timestamp`` column; names
    trimmed and lower-cased; mixed date spellings; optional volume kept."""
    x = spark.read.option("header", True).csv(paths)
    x = x.toDF(*[c.strip().lower() for c in x.columns])
    if "timestamp" in x.columns:
        raw = F.trim("timestamp")
    elif "time" in x.columns:
        raw = F.concat_ws(" ", F.trim("date"), F.trim("time"))
    else:
        raw = F.trim("date")
    ts = F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)) for f in DATE_FORMATS]).cast("timestamp_ntz")
    extra = [F.col("volume").try_cast("double").alias("volume")] if "volume" in x.columns else []
    return x.select(F.col("_metadata.file_path").alias("file"), ts.alias("ts"),
                    *[F.trim(n).try_cast("double").alias(n) for n in OHLC], *extra)


#: Header tables up to this many files are broadcast; larger ones join by shuffle.
BROADCAST_FILES = 100_000


def _cells(line: Column) -> Column:
    return F.transform(F.split(line, ",", -1), lambda c: F.trim(F.regexp_replace(c, "[\"']", "")))


def read_bar_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """A1–A3 in one plan: every line of every file, parsed in the layout of its own file.
    The headers are one row per file, joined to the lines, so files of any mix of layouts
    need no list on the driver.  Columns: file, ts, open, high, low, close (null where a
    cell does not parse); header and blank lines give no row."""
    heads = detect_bar_format(spark, paths).where("format = 'headed'").select(
        "file", F.split("header", ",").alias("names"))
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    small = F.broadcast(heads) if heads.count() <= BROADCAST_FILES else heads
    x = lines.join(small, "file", "left").withColumn("c", _cells(F.col("value")))
    x = x.where(~F.lower(F.col("c")[0]).isin("date", "timestamp"))

    def cell(name: str) -> Column:
        at = F.array_position("names", name).cast("int")
        return F.when(at > 0, F.get("c", at - 1))

    stamp = F.coalesce(cell("timestamp"), F.concat_ws(" ", cell("date"), cell("time")))
    headed = F.coalesce(*[F.try_to_timestamp(stamp, F.lit(f)) for f in DATE_FORMATS])
    compact = F.try_to_timestamp(F.concat(F.get("c", F.lit(0)), F.lpad(F.get("c", F.lit(1)), 4, "0")), F.lit("yyyyMMddHHmm"))
    has_head = F.col("names").isNotNull()
    return x.select("file", F.when(has_head, headed).otherwise(compact).cast("timestamp_ntz").alias("ts"),
                    *[F.when(has_head, cell(n)).otherwise(F.get("c", F.lit(i + 2))).try_cast("double").alias(n)
                      for i, n in enumerate(OHLC)])


def read_bars_dir(spark: SparkSession, directory: str, nested: bool = False) -> tuple[DataFrame, DataFrame]:
    """A4: every ``*.csv`` and ``*.txt`` under a folder; each file read in its
    detected format, symbol = file stem.  With ``nested`` the files lie in folders
    named ``symbol=<name>``, any number to a symbol.  Returns (bars, per-file report);
    a file whose rows all fail to parse is reported and contributes nothing."""
    paths = [f"{directory}/*/*.csv"] if nested else [f"{directory}/*.csv", f"{directory}/*.txt"]
    symbol = F.regexp_extract("file", r"/symbol=([^/]+)/", 1) if nested else _file_stem(F.col("file"))
    rows = read_bar_lines(spark, paths)
    rep = rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("ts").isNull()).alias("bad_rows"))
    # a row without a time is no bar, so a rejected file has none
    return rows.where(F.col("ts").isNotNull()).select(symbol.alias("symbol"), "ts", *OHLC), \
        rep.withColumn("rejected", F.col("rows") == F.col("bad_rows"))


def scan_csv(spark: SparkSession, glob: str, start: str | None = None, end: str | None = None,
             columns: Sequence[str] | None = None, text_compare: bool = False) -> DataFrame:
    """A5: raw scan of a glob (union by name), optional date range on the
    ``Date`` column (parsed dates; ``text_compare`` keeps the reference's text
    comparison), optional projection, ordered by the first two columns."""
    x = spark.read.option("header", True).option("inferSchema", True).csv(glob)
    if start or end:
        if text_compare:
            d = F.col("Date").cast("string")
            lo, hi = F.lit(start or ""), F.lit(end or "9999")
        else:
            d = F.coalesce(*[F.try_to_date(F.col("Date").cast("string"), f)
                             for f in ("yyyy/MM/dd", "yyyy-MM-dd")])
            lo, hi = F.to_date(F.lit(start or "0001-01-01")), F.to_date(F.lit(end or "9999-12-31"))
        x = x.where(d.between(lo, hi))
    if columns:
        x = x.select(*columns)
    return x.orderBy(*x.columns[:2])


def csv_date_range(spark: SparkSession, glob: str) -> DataFrame:
    """Min and max of the ``Date`` column as text, first 10 characters."""
    x = spark.read.option("header", True).csv(glob)
    return x.agg(F.substring(F.min("Date"), 1, 10).alias("start"), F.substring(F.max("Date"), 1, 10).alias("end"))


def build_minute_table(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Trading day + session on every bar, with the month partition column."""
    from barlake.operators.sessions import assign_trading_day
    x = assign_trading_day(bars, list(keys))
    return x.withColumn("trading_day_month", F.date_format("trading_day", "yyyy-MM"))


# --------------------------------------------------------------------------
# strategy library
# --------------------------------------------------------------------------

REQUIRED_FIELDS = ["name", "holding_type", "category", "timeframe", "direction", "description"]
# Allowed holding types and known categories
HOLDING_TYPES = ["daytrade", "swing"]
CATEGORIES = ["trend", "mean_reversion", "breakout", "pattern", "tunnel"]

LIB_SCHEMA = T.StructType([
    T.StructField("folder", T.StringType()), T.StructField("stem", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("holding_type", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("timeframe", T.StringType()), T.StructField("direction", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("risk_features", T.ArrayType(T.StringType())),
    T.StructField("notes", T.StringType()), T.StructField("reject_reason", T.StringType())])


def _parse_meta(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml
    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)      # the C parser where it is built in
    for pdf in it:
        rows = []
        for folder, stem, content in zip(pdf["folder"], pdf["stem"], pdf["content"]):
            rec = {f.name: None for f in LIB_SCHEMA.fields}
            rec["folder"], rec["stem"] = folder, stem
            try:
                meta = yaml.load(bytes(content).decode("utf-8"), Loader=loader) or {}
            except Exception as e:  # noqa: BLE001
                rec["reject_reason"] = f"bad yaml: {type(e).__name__}"
                rows.append(rec)
                continue
            missing = [f for f in REQUIRED_FIELDS if not meta.get(f)]
            for f in REQUIRED_FIELDS:
                rec[f] = None if meta.get(f) is None else str(meta.get(f)).strip()
            if rec["holding_type"]:
                rec["holding_type"] = rec["holding_type"].lower()
            if rec["category"]:
                rec["category"] = rec["category"].lower()
            rec["risk_features"] = [str(v) for v in (meta.get("risk_features") or [])]
            rec["notes"] = None if meta.get("notes") is None else str(meta.get("notes"))
            if missing:
                rec["reject_reason"] = "missing: " + ",".join(missing)
            elif rec["holding_type"] not in HOLDING_TYPES:
                rec["reject_reason"] = f"bad holding_type: {rec['holding_type']}"
            rows.append(rec)
        yield pd.DataFrame(rows, columns=[f.name for f in LIB_SCHEMA.fields])


def _decode(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        out = []
        for b in pdf["content"]:
            b = bytes(b)
            try:
                out.append(b.decode("utf-8"))
            except UnicodeDecodeError:
                out.append(b.decode("cp950", errors="replace"))
        yield pd.DataFrame({"folder": pdf["folder"], "stem": pdf["stem"], "code": out})


def _parse_library(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Metadata rows and script rows (``script`` true) of library files."""
    for pdf in it:
        meta, script = pdf[~pdf["script"]], pdf[pdf["script"]]
        yield from (x.assign(script=False, code=None) for x in _parse_meta(iter([meta])) if len(x))
        for x in _decode(iter([script])):
            if len(x):
                yield x.assign(script=True).reindex(columns=[*(f.name for f in LIB_SCHEMA.fields), "script", "code"]) \
                    .astype(object).where(lambda d: d.notna(), None)


def load_strategy_library(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Pair ``*/*.yaml`` metadata with the script of the same folder and stem; drop
    unpaired entries (C13), missing required fields and bad holding types
    (unknown categories are kept and flagged).  Returns (library, rejects)."""
    folder, stem = F.regexp_extract(F.col("path"), r"([^/]*)/[^/]*$", 1), _file_stem(F.col("path"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(~F.col("path").endswith(".md"))
    rows = parsed_files(files.select(folder.alias("folder"), stem.alias("stem"), (~F.col("path").endswith(".yaml")).alias("script"), "content"),
                        _parse_library, T.StructType([*LIB_SCHEMA.fields, T.StructField("script", T.BooleanType()), T.StructField("code", T.StringType())]))
    m = rows.where("NOT script").drop("script", "code")
    code = rows.where("script").select("folder", "stem", "code")
    key = ["folder", "stem"]
    paired = m.join(code, key, "inner")
    unpaired = m.join(code, key, "left_anti").withColumn("reject_reason", F.lit("no script file"))
    ok = paired.where(F.col("reject_reason").isNull()).withColumn(
        "unknown_category", ~F.col("category").isin(*CATEGORIES))
    rejects = paired.where(F.col("reject_reason").isNotNull()).select(*key, "reject_reason") \
        .unionByName(unpaired.select(*key, "reject_reason"))
    return ok.drop("reject_reason"), rejects


# --------------------------------------------------------------------------
# performance report files
# --------------------------------------------------------------------------

# Report fields and the label patterns that name them, in order; the
# first field with a pattern inside a label takes the row
REPORT_PATTERNS = [
    ("sharpe_ratio", ["Sharpe Ratio", "夏普指標", "夏普比率"]),
    ("max_drawdown_pct", ["Max. Drawdown %", "最大回撤%", "MaxDD%", "Max Drawdown %"]),
    ("max_drawdown_abs", ["Max. Drawdown", "Max Intraday Drawdown", "最大回撤"]),
    ("profit_factor", ["Profit Factor", "獲利因子", "盈利因子"]),
    ("total_trades", ["Total Number of Trades", "Total Trades", "總交易次數", "交易次數"]),
    ("winning_trades", ["Winning Trades", "獲利交易", "盈利交易"]),
    ("percent_profitable", ["Percent Profitable", "勝率", "盈利百分比"]),
    ("total_net_profit", ["Total Net Profit", "總淨利", "净利润"]),
    ("gross_profit", ["Gross Profit", "毛利", "总盈利"]),
    ("gross_loss", ["Gross Loss", "毛損", "总亏损"]),
    ("avg_win", ["Winning Trades Avg.", "Avg. Winning Trade", "平均獲利"]),
    ("avg_loss", ["Losing Trades Avg.", "Avg. Losing Trade", "平均虧損"]),
]
# Fields that a report must have, and the encodings that are tried
REPORT_REQUIRED = ["sharpe_ratio", "profit_factor", "total_trades"]
REPORT_ENCODINGS = ["utf-8-sig", "utf-8", "cp950", "gbk"]


def _report_lines(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Label and value cells of report files (small files, one row each)."""
    import csv
    import io
    for pdf in it:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            text = None
            for enc in REPORT_ENCODINGS:
                try:
                    text = bytes(content).decode(enc)
                    break
                except UnicodeDecodeError:
                    continue
            text = bytes(content).decode("utf-8", "replace") if text is None else text
            for n, row in enumerate(csv.reader(io.StringIO(text))):
                if row:
                    out.append((path, n, row[0].strip().strip('"'), row[1].strip().strip('"') if len(row) > 1 else ""))
        yield pd.DataFrame(out, columns=["file", "row", "label", "raw"])


def parse_report_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Ragged ``label, value`` rows → one row per file.  Each row goes to one
    field, each field takes its first value that parses; a drawdown without a
    percentage is 0, losses are positive, the win rate comes from the percentage or
    from the trades, and ``missing`` names the required fields without a value."""
    from barlake.operators.textops import parse_report_number
    cells = parsed_files(spark.read.format("binaryFile").load(paths).select("path", "content"), _report_lines,
                         "file string, row long, label string, raw string")
    field = F.lit(None).cast("string")
    for name, patterns in reversed(REPORT_PATTERNS):
        hit = F.lit(False)
        for p in patterns:
            hit = hit | F.contains(F.lower("label"), F.lit(p.lower()))
        field = F.when(hit, name).otherwise(field)
    x = cells.withColumn("field", field).withColumn("num", parse_report_number(F.col("raw"))).where("field is not null")
    names = [n for n, _ in REPORT_PATTERNS]
    wide = x.groupBy("file").agg(*[F.min_by(F.when(F.col("field") == n, F.col("num")), F.when(
        (F.col("field") == n) & F.col("num").isNotNull(), F.col("row"))).alias(n) for n in names])
    every = cells.select("file").distinct().join(wide, "file", "left")
    pct = F.abs("max_drawdown_pct") / 100
    rate = F.when(F.col("percent_profitable").isNotNull(), F.col("percent_profitable") / 100).when(
        F.col("winning_trades").isNotNull() & F.col("total_trades").isNotNull(),
        F.when(F.col("total_trades").cast("long") == 0, 0.0).otherwise(F.col("winning_trades") / F.col("total_trades").cast("long")))
    return every.withColumns({
        "win_rate": rate,
        "max_drawdown_pct": F.when(F.col("max_drawdown_pct").isNotNull(), pct).when(F.col("max_drawdown_abs").isNotNull(), 0.0),
        "total_trades": F.col("total_trades").cast("long"), "gross_loss": F.abs("gross_loss"), "avg_loss": F.abs("avg_loss"),
        "missing": F.concat_ws(",", *[F.when(F.col(f).isNull(), F.lit(f)) for f in REPORT_REQUIRED])})
