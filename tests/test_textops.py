from pyspark.sql import functions as F

from barlake.operators import textops as tx


def test_title_and_text(spark):
    html = ("<html><head><TITLE>  A &amp;  B\n &copy; </TITLE><style>p{}</style><script>x=1</script></head>"
            "<body><p>Hello&nbsp;<b>world</b> &amp &lt;3</p></body></html>")
    df = spark.createDataFrame([(html,)], "html string")
    r = df.select(tx.extract_title("html").alias("t"), tx.extract_text("html").alias("x")).first()
    assert r.t == "A & B ©"
    assert r.x == "A & B © Hello world & <3"


def test_lint_rules(spark):
    good = ("Inputs: L(0.8);\nVars: k(1);\nif EntriesToday(d) = 0 and time >= 0845 then begin\n"
            "buy 1 contracts next bar at h stop;\nsell short 1 contracts next bar at l stop;\nend;\n"
            "SetStopLoss(50);\nif time = 1339 then sell next bar at market;\n")
    bad = "buy 1 shares at market;\nif x then begin\nVolume"
    df = spark.createDataFrame([(good,), (bad,)], "code string")
    out = df.select(tx.lint_issues("code").alias("i")).select(
        F.transform("i", lambda e: e["rule"]).alias("r"), tx.lint_passed(F.col("i")).alias("ok")).collect()
    assert out[0].r == [] and out[0].ok
    assert {"R01", "R02", "R03", "R05", "R07", "R09", "R10", "R12"} <= set(out[1].r) and not out[1].ok


def test_error_patterns(spark):
    msgs = ["Unknown identifier 'Volum' at line 12", "Mismatched 'Begin' at line 5", "Expected ';'", "boom"]
    df = spark.createDataFrame([(m,) for m in msgs], "m string")
    got = [r[0] for r in df.select(tx.normalise_error("m")).collect()]
    assert got == ["UNKNOWN_IDENTIFIER:Volum", "MISMATCHED_BEGIN_END", "SYNTAX_EXPECTED", "OTHER"]


def test_fence_and_json(spark):
    t = "intro\n```easylanguage\n    a = 1;\n      b = 2;\n```\n```json\n{\"analysis\": \"x\"}\n```"
    df = spark.createDataFrame([(t,), ('{"analysis": "y", "suggestions": []}',), ("no json {here",)], "t string")
    j = tx.json_payload(F.col("t"))
    out = df.select(tx.fenced_block("t").alias("f"), j["method"].alias("m")).collect()
    assert out[0].f == "a = 1;\n  b = 2;" and out[0].m == "fence"
    assert out[1].m == "whole" and out[2].m == "failed"


def test_unescape_sends_references_only(spark):
    """Whole texts stay out of Python; the result is that of the standard library."""
    import html
    texts = ["", "none", "&", "&&amp;&", "&amp;", "a &amp b&copy;&notit; &#65;&#x42&#x1F600;x &nosuch; &#0;&#128; 漢&eacute😀&lt;", "&NewLine;&nbsp;\n&#10;|",
             "&" + "a" * 40, "&amp;" * 300, "& amp; &\tlt; &#; &#x; &#xZ;", "a\r&gt\r&Aacute;\f&\fgt;", "& lt;&#x10FFFF;&#xD800;", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df.select("i", tx.html_unescape("t").alias("u"))
    got = {r.i: r.u for r in out.collect()}
    assert got == {i: t if t is None else html.unescape(t) for i, t in enumerate(texts)}
    sent = [n for n in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "EvalPython" in n]
    assert len(sent) == 1 and "array<string>" in tx.decoded_references.returnType.simpleString()
