"""Named plans: page, document, model-output and script text jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlake.operators import textops as tx
from barlake.sources import fixtures as fx


def _pages(spark, sf_dir):
    p = fx.spread(fx.table(spark, sf_dir, "pages"))
    # two steps: decoding reads its input twice, which would run the patterns of one step twice
    p = p.select("page_id", "url", tx.raw_title("html").alias("_title"), tx.raw_text("html").alias("_text"))
    return p.select("page_id", "url", tx.decoded_title("_title", clip=200).alias("title"),   # the reference's title length
                    tx.decoded_text("_text").alias("text"))


def page_title_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1/K2 on every page (title falls back to the URL)."""
    p = _pages(spark, sf_dir)
    return p.select("page_id", "title", F.when(F.col("title") == "", F.col("url")).otherwise(F.col("title"))
                    .alias("title_or_url"), "text", F.length("text").alias("n_chars"))


def page_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I18 on extracted page text."""
    return tx.dedup_pages(_pages(spark, sf_dir)).select("page_id", "url_hash", "content_hash", "keep")


def page_list_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allow example.com / example.org domains, deny mobile hosts."""
    allow = spark.createDataFrame([("example.com",), ("example.org",)], "domain string")
    p = fx.table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = p.select(tx.url_host("url").alias("host")).where(F.startswith("host", F.lit("m.")))
    return tx.list_filter(p, allow, hosts.distinct()).select("page_id", "host", "domain")


def knowledge_context(spark: SparkSession, sf_dir: str, max_urls: int = 8,
                      max_chars: int = 3000) -> DataFrame:
    """B11 per tag (the URL's language segment): pages with content, first 8
    by id, each clipped to 3000 characters, concatenated in order."""
    p = _pages(spark, sf_dir).withColumn("tag", F.regexp_extract("url", r"://[^/]+/([a-z]{2})/", 1))
    p = p.where(F.length("text") > 0)
    w = Window.partitionBy("tag").orderBy("page_id")
    p = p.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_urls)
    block = F.format_string("### [%s](%s)\n%s\n", F.col("title"), F.col("url"),
                            F.substring("text", 1, max_chars))
    g = p.groupBy("tag").agg(F.count(F.lit(1)).alias("n_pages"),
                             F.array_sort(F.collect_list(F.struct("page_id", block.alias("b")))).alias("_l"))
    return g.select("tag", "n_pages", F.array_join(F.transform("_l", lambda e: e["b"]), "\n").alias("context"))


def document_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact-duplicate documents by content hash (first doc id kept)."""
    d = fx.spread(fx.table(spark, sf_dir, "documents")).select("doc_id", F.sha2("text", 256).alias("content_hash"))
    first = d.groupBy("content_hash").agg(F.min("doc_id").alias("first_doc_id"))   # partial aggregate
    return d.join(first, "content_hash").withColumn("is_duplicate", F.col("doc_id") != F.col("first_doc_id"))


def script_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8 over every document as a script (day-trading class)."""
    d = fx.spread(fx.table(spark, sf_dir, "documents"))
    iss = tx.lint_issues("text", "daytrade_day")
    x = d.select("doc_id", iss.alias("issues"))
    return x.select("doc_id", F.array_join(F.transform("issues", lambda i: i["rule"]), ",").alias("rules"),
                    F.size(F.filter("issues", lambda i: i["severity"] == "fatal")).alias("n_fatal"),
                    tx.lint_passed(F.col("issues")).alias("passed"))


def _scripts(spark, sf_dir):
    """Documents as scripts: comments of every kind behind the text and, for even
    ids, a class with the method that K14 summarises."""
    d = fx.spread(fx.table(spark, sf_dir, "documents"))
    tail = F.concat(F.lit("\n// note é\nx = 1 // tail ü\r\nbuy {"), F.col("lang"),
                    F.lit(" ñ} now // ok ö\nsell {ß} next\nkeep {this} // ascii\n{open é"))
    method = F.concat(F.lit('\nclass A:\n    NAME = "'), F.col("source"),
                      F.lit('"\n    def generate_signals(self):\n        '), F.col("text"),
                      F.lit("  \n\n        return 1\n    def other(self):\n        pass"))
    return d.select("doc_id", "source", F.concat("text", tail, F.when(F.col("doc_id") % 2 == 0, method).otherwise("")).alias("text"))


def script_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5, K6, K7, K14, K16, K20 over every document as a script."""
    d = _scripts(spark, sf_dir)
    return d.select(
        "doc_id",
        tx.extract_attr("text", "NAME", "Unknown").alias("name"),
        tx.extract_attr("text", "CATEGORY", "unknown").alias("category"),
        tx.extract_attr("text", "TIMEFRAME", "1min").alias("timeframe"),
        tx.extract_attr("text", "HOLDING_TYPE", "daytrade").alias("holding_type"),
        tx.required_tokens("text").alias("missing"),
        tx.effective_lines("text").alias("effective_lines"),
        tx.safe_name(F.col("source")).alias("safe_source"),
        F.sha2(tx.strip_non_ascii_comments("text"), 256).alias("stripped_hash"),
        tx.summarise_code("text", tx.SUMMARY_LINES, tx.SUMMARY_CHARS).alias("summary"))


def json_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3/K4 on wrapped model outputs."""
    o = fx.spread(fx.outputs_fx(spark, sf_dir))
    j = tx.json_payload(F.col("output"))
    x = o.select("conv_id", "turn", "source_text", "output", j["json"].alias("_js"),
                 j["method"].alias("method"), j["parsed"].alias("parsed"))
    return x.select("conv_id", "turn", "method", "parsed",
                    (F.get_json_object("_js", "$.analysis") == F.col("source_text")).alias("analysis_ok"),
                    F.json_array_length(F.get_json_object("_js", "$.suggestions")).alias("n_suggestions"),
                    F.length(tx.fenced_block(F.col("output"), ("json", ""), False)).alias("fence_chars"))


def error_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K10 per log row."""
    v = fx.validation_log_fx(spark, sf_dir)
    return v.select("log_id", "layer", "passed", tx.normalise_error("message").alias("error_pattern"))


def top_failure_patterns(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """Most frequent patterns of failed layer-3 checks (top k is the feature)."""
    v = fx.validation_log_fx(spark, sf_dir).where(~F.col("passed") & (F.col("layer") == 3))
    g = v.groupBy(tx.normalise_error("message").alias("error_pattern")).agg(F.count(F.lit(1)).alias("cnt"))
    top = g.orderBy(F.col("cnt").desc(), F.col("error_pattern")).limit(k)   # TakeOrdered: k rows
    w = Window.orderBy(F.col("cnt").desc(), F.col("error_pattern"))
    return top.withColumn("rank", F.row_number().over(w))


def frequent_patterns(spark: SparkSession, sf_dir: str, trigger: int = 50) -> DataFrame:
    """Failed patterns whose count reaches the trigger."""
    v = fx.validation_log_fx(spark, sf_dir).where(~F.col("passed"))
    g = v.groupBy(tx.normalise_error("message").alias("error_pattern")).agg(F.count(F.lit(1)).alias("cnt"))
    return g.where(F.col("cnt") >= trigger)


def fail_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One formatted failure entry per failed validation."""
    v = fx.validation_log_fx(spark, sf_dir).where(~F.col("passed"))
    kind = fx.table(spark, sf_dir, "events").select(F.col("event_id").alias("log_id"), F.col("event_type").alias("kind"))
    direction = F.when(F.col("layer") == 1, "long").otherwise("both")
    reasons = F.array(tx.normalise_error("message"), F.concat(F.lit("layer "), F.col("layer").cast("string")))
    return v.join(kind, "log_id").select("log_id", tx.fail_record_text(
        "created_at", "kind", direction, F.lit("1min"), F.col("strategy_id").cast("string"), "message", reasons).alias("record"))


def critique_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9 on critique records derived from the assistant turns."""
    cv = fx.table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    forb = F.when(F.contains(F.lower("text"), F.lit("volume")), F.array(F.lit("Volume"))).otherwise(
        F.array().cast("array<string>"))
    quality = F.element_at(F.array(F.lit("good"), F.lit("acceptable"), F.lit("poor")),
                           (F.col("conv_id") % 3 + 1).cast("int"))
    js = F.to_json(F.struct((F.col("turn") / F.lit(10.0)).alias("syntax_confidence"),
                            (F.col("conv_id") % 2 == 0).alias("logic_match"),
                            F.contains("text", F.lit("a")).alias("has_stop_loss"),
                            (F.length("text") > 100).alias("has_force_close"),
                            forb.alias("uses_forbidden_keywords"), quality.alias("overall_quality")))
    x = cv.select("conv_id", "turn", js.alias("critique"))
    return x.select("conv_id", "turn", tx.critique_passed(F.col("critique"), daytrade=True).alias("passed"))


def knowledge_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page knowledge base without mobile hosts (removed by key),
    listed with content length."""
    from barlake.sources import tables as tb
    p = fx.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), "url", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"),
        F.col("html").alias("content"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("added_at"))
    drop = p.where(F.startswith(tx.url_host("url"), F.lit("m."))).select("url")
    return tb.list_knowledge(tb.remove_by_key(p, drop, ["url"]))
