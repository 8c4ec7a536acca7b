"""Bar file readers, library loader and report parsing on small written files."""
import os
import tempfile

from pyspark.sql import functions as F

from barlake.sources import bars_csv as bc
from barlake.operators import textops as tx


def _write(d, name, text):
    with open(os.path.join(d, name), "w", encoding="utf-8") as f:
        f.write(text)


def test_read_bars_dir(spark):
    d = tempfile.mkdtemp(prefix="bars-")
    _write(d, "TXA.txt", "20150105,901,100,101,99,100.5\n20150105,0902,100.5,102,100,101\n")
    _write(d, "TXB.csv", "Date, Time ,Open,High,Low,Close,Volume\n2015/01/05,09:01:00,1,2,0.5,1.5,10\n"
                         "2015-01-05,09:02:00,1.5,2,1,1.8,0\n")
    _write(d, "TXC.csv", "timestamp,open,high,low,close\n2015-01-05 09:01:00,5,6,4,5.5\n")
    _write(d, "BAD.txt", "garbage,line,here\nmore,junk,x\n")
    bars, rep = bc.read_bars_dir(spark, d)
    got = {(r.symbol, r.ts.strftime("%H:%M")): r.close for r in bars.collect()}
    assert got[("TXA", "09:01")] == 100.5 and got[("TXA", "09:02")] == 101.0
    assert got[("TXB", "09:01")] == 1.5 and got[("TXC", "09:01")] == 5.5
    rejected = {os.path.basename(r.file) for r in rep.where("rejected").collect()}
    assert rejected == {"BAD.txt"}
    fmt = {os.path.basename(r.file): r.format for r in bc.detect_bar_format(spark, [f"{d}/*.csv", f"{d}/*.txt"]).collect()}
    assert fmt["TXA.txt"] == "compact" and fmt["TXB.csv"] == "headed"


def test_scan_and_date_range(spark):
    d = tempfile.mkdtemp(prefix="scan-")
    _write(d, "a.csv", "Date,Close\n2015/01/05,1\n2015-01-07,2\n2015/02/01,3\n")
    x = bc.scan_csv(spark, f"{d}/*.csv", "2015-01-01", "2015-01-31")
    assert sorted(r.Close for r in x.collect()) == [1, 2]
    r = bc.csv_date_range(spark, f"{d}/*.csv").first()
    assert r.start == "2015-01-07" and r.end == "2015/02/01"  # text comparison, as the reference does


def test_library_loader(spark):
    root = tempfile.mkdtemp(prefix="lib-")
    os.makedirs(f"{root}/Daytrade")
    _write(f"{root}/Daytrade", "A1.yaml", "name: A1\nholding_type: DayTrade\ncategory: trend\ntimeframe: 5min\n"
                                          "direction: both\ndescription: x\nrisk_features: [a, b]\n")
    _write(f"{root}/Daytrade", "A1.ELS", "inputs: x(1);")
    _write(f"{root}/Daytrade", "A2.yaml", "name: A2\nholding_type: swing\n")
    _write(f"{root}/Daytrade", "A2.ELS", "vars: k(1);")
    _write(f"{root}/Daytrade", "A3.yaml", "name: A3\nholding_type: swing\ncategory: odd\ntimeframe: 1d\n"
                                          "direction: long\ndescription: y\n")
    lib, rej = bc.load_strategy_library(spark, root)
    rows = {r.stem: r for r in lib.collect()}
    assert set(rows) == {"A1"} and rows["A1"].holding_type == "daytrade" and rows["A1"].risk_features == ["a", "b"]
    reasons = {r.stem: r.reject_reason for r in rej.collect()}
    assert reasons["A2"].startswith("missing") and reasons["A3"] == "no script file"


def test_report_files(spark):
    d = tempfile.mkdtemp(prefix="rep-")
    _write(d, "r1.csv", 'Total Net Profit,"$1,234,567"\nProfit Factor,1.85\nMax. Drawdown %,-26.52%\nMax. Drawdown,"($234,567)"\n'
                        'Total Number of Trades,120\nPercent Profitable,48.5%\nSharpe Ratio,—\nGross Loss,"($9,000)"\n')
    with open(os.path.join(d, "r2.csv"), "wb") as f:
        f.write("夏普指標,1.5\n最大回撤,100\n交易次數,50\n獲利交易,20\n獲利因子,1.2\n".encode("cp950"))
    got = {os.path.basename(r.file): r for r in bc.parse_report_files(spark, f"{d}/*.csv").collect()}
    r = got["r1.csv"]
    assert r.total_net_profit == 1234567.0 and r.profit_factor == 1.85 and abs(r.max_drawdown_pct - 0.2652) < 1e-12
    assert r.max_drawdown_abs == -234567.0 and r.total_trades == 120 and r.win_rate == 0.485 and r.gross_loss == 9000.0
    assert r.sharpe_ratio is None and r.missing == "sharpe_ratio"
    r = got["r2.csv"]
    assert r.sharpe_ratio == 1.5 and r.max_drawdown_pct == 0.0 and r.win_rate == 0.4 and r.missing == ""


def test_report_numbers(spark):
    df = spark.createDataFrame([("$1,234,567",), ("($234,567)",), ("-26.52%",), ("—",), ("N/A",), ("-$5",), ("5$",), ("1 234",), ("(12%)",)], "s string")
    out = [r[0] for r in df.select(tx.parse_report_number(F.col("s"))).collect()]
    assert out == [1234567.0, -234567.0, -26.52, None, None, None, None, None, -12.0]


def test_library_of_many_small_files(spark, tmp_path):
    """Small files are read many to a task (the stored rows show the tasks), each once, with the right pairs."""
    from barlake.sources import files as fl
    (tmp_path / "lib").mkdir()
    for i in range(400):
        _write(str(tmp_path / "lib"), f"S{i}.yaml", f"name: S{i}\nholding_type: swing\ncategory: trend\ntimeframe: 1d\ndirection: long\ndescription: d{i}\n")
        _write(str(tmp_path / "lib"), f"S{i}.ELS", f"code {i}")
    _write(str(tmp_path / "lib"), "notes.md", "no script")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    lib, rej = bc.load_strategy_library(spark, str(tmp_path))
    assert {r.stem: (r.description, r.code) for r in lib.collect()} == {f"S{i}": (f"d{i}", f"code {i}") for i in range(400)}
    assert rej.count() == 0 and len(lib.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.files.openCostInBytes") == cost
    assert fl.SMALL_FILE_COST < 4 << 20
