"""Text, JSON and script jobs over tables.

Everything is a column expression on whole texts except HTML entity decoding,
whose references go to the standard library's decoder in an Arrow-batched pandas
UDF (the full entity table has over two thousand names; JVM functions have none).

Script-language checks (K5–K8, K20) use ASCII word boundaries written out as
character classes, and count keywords over a lower-cased token split, so the
same rule gives the same answer in any regex engine.
"""

from __future__ import annotations

import html

import pandas as pd
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WS = r"(?U)\s+"


# what HTML5 decoding takes for a character reference (the pattern of html.unescape); none holds a space
CHARREF = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@F.pandas_udf(T.ArrayType(T.StringType()))
def decoded_references(refs: pd.Series) -> pd.Series:
    """The characters of space-joined references, one element each."""
    known = {r: html.unescape(r) for r in {r for v in refs if v for r in v.split(" ")}}
    return refs.map(lambda v: [known[r] for r in v.split(" ")] if v else ([] if v == "" else None))


def html_unescape(x) -> Column:
    """HTML5 entity decoding (named, numeric, legacy no-semicolon forms).  Only the
    references of a text go through Python, never the text between them."""
    refs = decoded_references(F.array_join(F.regexp_extract_all(c(x), F.lit(CHARREF), F.lit(0)), " "))
    pieces = F.zip_with(F.split(c(x), CHARREF, -1), refs, lambda text, ref: F.concat(text, F.coalesce(ref, F.lit(""))))
    return F.array_join(pieces, "")


@F.pandas_udf(T.BooleanType())
def is_json_object(s: pd.Series) -> pd.Series:
    """Strict JSON check (whole string must be one JSON object)."""
    import json

    def ok(v):
        if not isinstance(v, str):
            return None
        try:
            return isinstance(json.loads(v), dict)
        except ValueError:
            return False
    return s.map(ok)


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse_ws(x) -> Column:
    return F.regexp_replace(c(x), WS, " ")


def strip_ws(x) -> Column:
    return F.regexp_replace(c(x), r"^(?U)\s+|(?U)\s+$", "")


def clipped(x: Column, clip: int | None) -> Column:
    """The first ``clip`` characters (None: the whole text)."""
    return x if clip is None else F.substring(x, 1, clip)


def raw_title(html_col) -> Column:
    """The first <title> of a page, references not decoded."""
    return collapse_ws(F.regexp_extract(c(html_col), r"(?is)<title[^>]*>(.*?)</title>", 1))


def raw_text(html_col) -> Column:
    """A page without script/style blocks and tags, references not decoded."""
    t = F.regexp_replace(c(html_col), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.regexp_replace(t, r"<[^>]+>", " ")


def decoded_title(raw, clip: int | None = None) -> Column:
    return clipped(strip_ws(html_unescape(raw)), clip)


def decoded_text(raw, clip: int | None = None) -> Column:
    return clipped(strip_ws(collapse_ws(html_unescape(raw))), clip)


def extract_title(html_col, clip: int | None = None) -> Column:
    """K1: first <title>, whitespace collapsed, entities decoded, stripped."""
    return decoded_title(raw_title(html_col), clip)


def extract_text(html_col, clip: int | None = None) -> Column:
    """K2: drop script/style blocks and tags, decode, collapse, strip."""
    return decoded_text(raw_text(html_col), clip)


def dedent_strip(x) -> Column:
    """textwrap.dedent (common leading spaces/tabs of non-blank lines) + strip."""
    lines = F.split(c(x), "\n")
    ind = F.transform(F.filter(lines, lambda l: F.length(F.trim(l)) > 0),
                      lambda l: F.length(F.regexp_extract(l, r"^[ \t]*", 0)))
    m = F.coalesce(F.array_min(ind), F.lit(0))
    body = F.array_join(F.transform(lines, lambda l: F.when(F.length(F.trim(l)) == 0, F.lit(""))
                                    .otherwise(F.substring(l, m + 1, 1 << 30))), "\n")
    return strip_ws(body)


def fenced_block(text, langs=("easylanguage", "powerlanguage", "el", ""), fallback_whole=True) -> Column:
    """K3: the first fence by language priority (``''`` = bare fence), dedented;
    empty → the whole text, stripped (``fallback_whole``) or ''."""
    cands = []
    for lang in langs:
        pat = rf"(?is)```{lang}\s*\n(.*?)```" if lang else r"(?s)```\s*\n(.*?)```"
        cands.append(F.nullif(dedent_strip(F.regexp_extract(c(text), pat, 1)), F.lit("")))
    out = F.coalesce(*cands)
    return F.coalesce(out, strip_ws(c(text)) if fallback_whole else F.lit(""))


def json_payload(text) -> dict[str, Column]:
    """K4: whole text → ```json fence → first '{' … last '}' → failed.

    Returns ``{json, method, parsed}``: the accepted JSON object text, how it
    was found, and whether parsing succeeded."""
    t = c(text)

    def obj(s: Column) -> Column:
        return F.when(F.coalesce(is_json_object(s), F.lit(False)), s)

    whole = obj(t)
    fence = obj(F.regexp_extract(t, r"(?s)```json\s*\n(.*?)```", 1))
    first, last = F.locate("{", t), F.length(t) - F.locate("}", F.reverse(t)) + 1
    span = obj(F.when((first > 0) & (F.locate("}", F.reverse(t)) > 0) & (last > first),
                      F.substring(t, first, last - first + 1)))
    js = F.coalesce(whole, fence, span)
    method = (F.when(whole.isNotNull(), "whole").when(fence.isNotNull(), "fence")
              .when(span.isNotNull(), "braces").otherwise("failed"))
    return {"json": js, "method": method, "parsed": js.isNotNull()}


def extract_attr(code, key: str, default: str) -> Column:
    """K5: ``KEY = "value"`` (either quote), else the default."""
    v = F.regexp_extract(c(code), rf"{key}\s*=\s*[\"']([^\"']+)[\"']", 1)
    return F.when(v == "", F.lit(default)).otherwise(v)


# Required interface tokens and their messages (K6)
REQUIRED_TOKENS = [
    ("BaseStrategy", "missing BaseStrategy base class"),
    ("NAME", "missing NAME class attribute"),
    ("PARAMS", "missing PARAMS class attribute"),
    ("CATEGORY", "missing CATEGORY class attribute"),
    ("HOLDING_TYPE", "missing HOLDING_TYPE class attribute (daytrade / swing)"),
    ("TIMEFRAME", "missing TIMEFRAME class attribute (e.g. TIMEFRAME = \"15min\")"),
    ("generate_signals", "missing generate_signals() method"),
    ("metadata", "missing metadata() method"),
    ("validate_params", "missing validate_params() method"),
    ("shift(1)", "generate_signals() must call shift(1) to avoid look-ahead"),
]


def required_tokens(code) -> Column:
    """K6: messages for missing required substrings, joined by '; ' ('' = ok)."""
    msgs = [F.when(~F.contains(c(code), F.lit(tok)), F.lit(msg)) for tok, msg in REQUIRED_TOKENS]
    return F.array_join(F.filter(F.array(*msgs), lambda m: m.isNotNull()), "; ")


def strip_non_ascii_comments(code) -> Column:
    """K7, line by line, for lines that hold a non-ASCII character: a ``//`` comment
    line goes, another line is cut at its first ``//``, and if it still holds one,
    its ``{…}`` comments go.  Lines without such a character stay as they are; the
    result is joined with CRLF."""
    lines = F.split(F.regexp_replace(c(code), r"(\r\n|\n|\r)\z", ""), r"\r\n|\n|\r")

    def foreign(l):
        return F.regexp_like(l, F.lit(r"[^\x00-\x7F]"))

    def rstrip(l):
        return F.regexp_replace(l, r"\s+\z", "")

    def cut(l):
        at = F.locate("//", l)
        return F.when((at > 0) & foreign(l), rstrip(F.substring(l, F.lit(1), at - 1))).otherwise(l)

    def uncomment(l):
        return F.when(F.contains(l, F.lit("{")) & F.contains(l, F.lit("}")) & foreign(l),
                      rstrip(F.regexp_replace(l, r"\{[^}]*\}", ""))).otherwise(l)
    kept = F.filter(lines, lambda l: ~(F.regexp_like(l, F.lit(r"^\s*//")) & foreign(l)))
    return F.array_join(F.transform(F.transform(kept, cut), uncomment), "\r\n")


# --------------------------------------------------------------------------
# lint rules (K8)
# --------------------------------------------------------------------------

# ASCII word boundaries as look-arounds (same token semantics as splitting on
# [^a-z0-9_]+, without allocating the token array)
B0, B1 = r"(?<![a-z0-9_])", r"(?![a-z0-9_])"


def _has(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(f"(?d){pattern}"))


def _count_word(text: Column, word: str) -> Column:
    return F.regexp_count(text, F.lit(f"{B0}{word}{B1}"))


# Forbidden keywords of phase 1 plus the global list
FORBIDDEN_KEYWORDS = ["volume", "ticks", "openint", "timetominutes", "intrabarordergeneration"]


def lint_issues(code, trading_session: str = "daytrade_day",
                forbidden=tuple(FORBIDDEN_KEYWORDS)) -> Column:
    """K8: array of ``struct(rule, severity, message)`` for rules R01–R12 on
    the lower-cased script."""
    t = F.lower(c(code))
    nb = rf"{B0}next bar{B1}"
    rules = [
        ("R01", "fatal", ~_has(t, rf"{B0}inputs?\s*:"), F.lit("missing Inputs block")),
        ("R02", "fatal", ~_has(t, rf"{B0}(vars?|variables?)\s*:"), F.lit("missing Vars/Variables block")),
        ("R03", "fatal", ~_has(t, rf"{B0}buy{B1}.*{nb}"), F.lit("missing Buy ... Next Bar entry")),
        ("R04", "high", ~_has(t, rf"{B0}sell\s+short{B1}.*{nb}"), F.lit("missing Sell Short entry")),
        ("R05", "fatal", ~_has(t, rf"{B0}(setstoploss|setpercenttrailing|setdollartrailing){B1}"),
         F.lit("missing stop-loss")),
        ("R06", "medium", ~_has(t, rf"{B0}entriestoday\s*\(.*\)\s*=\s*0"),
         F.lit("add EntriesToday(Date) = 0 against repeated entries")),
    ]
    nbeg, nend = _count_word(t, "begin"), _count_word(t, "end")
    nif, nthen = _count_word(t, "if"), _count_word(t, "then")
    rules.append(("R07", "fatal", nbeg != nend,
                  F.format_string("Begin/End unbalanced (Begin=%d, End=%d)", nbeg, nend)))
    rules.append(("R08", "fatal", nif > nthen,
                  F.format_string("If/Then unbalanced (If=%d, Then=%d)", nif, nthen)))
    for kw in forbidden:
        rules.append(("R09", "fatal", _has(t, rf"{B0}{kw}{B1}"), F.lit(f"forbidden keyword: {kw}")))
    if trading_session == "daytrade_day":
        rules.append(("R10", "fatal", ~_has(t, rf"{B0}time\s*=\s*1339{B1}"), F.lit("missing 13:39 force close")))
        rules.append(("R11", "high", ~_has(t, rf"{B0}time\s*>=\s*0?845{B1}"), F.lit("missing opening-time lower bound")))
    elif trading_session == "daytrade_night":
        rules.append(("R10", "fatal", ~_has(t, rf"{B0}time\s*=\s*0?444{B1}"), F.lit("missing 04:44 force close")))
    bare = F.regexp_extract_all(t, F.lit(rf"(?d){B0}(buy\s+\d*\s*shares?\s+at\s+market){B1}"), F.lit(1))
    rules.append(("R12", "high", (F.size(bare) > 0) & ~F.forall(bare, lambda b: F.contains(b, F.lit("next bar"))),
                  F.lit("entry without Next Bar (look-ahead)")))
    arr = F.array(*[F.when(cond, F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"),
                                          msg.alias("message"))) for r, s, cond, msg in rules])
    return F.filter(arr, lambda x: x.isNotNull())


def lint_passed(issues: Column) -> Column:
    return ~F.exists(issues, lambda i: i["severity"] == "fatal")


# --------------------------------------------------------------------------
# small helpers on records
# --------------------------------------------------------------------------

def critique_passed(js, daytrade: bool = True) -> Column:
    """K9: syntax_confidence ≥ 0.7, logic/stop (and force close for
    day-trading) true, no forbidden keywords, quality good/acceptable."""
    g = lambda p: F.get_json_object(c(js), p)
    ok = ((g("$.syntax_confidence").cast("double") >= 0.7) & (g("$.logic_match") == "true")
          & (g("$.has_stop_loss") == "true")
          & (F.coalesce(F.json_array_length(g("$.uses_forbidden_keywords")), F.lit(0)) == 0)
          & g("$.overall_quality").isin("good", "acceptable"))
    if daytrade:
        ok = ok & (g("$.has_force_close") == "true")
    return F.coalesce(ok, F.lit(False))


def normalise_error(msg) -> Column:
    """UNKNOWN_IDENTIFIER:<name> / MISMATCHED_BEGIN_END / SYNTAX_EXPECTED / OTHER."""
    m = c(msg)
    ident = F.regexp_extract(m, r"'([A-Za-z0-9_]+)'", 1)
    return (F.when(F.contains(m, F.lit("Unknown identifier")) & (ident != ""),
                   F.concat(F.lit("UNKNOWN_IDENTIFIER:"), ident))
            .when(F.contains(m, F.lit("Mismatched")), F.lit("MISMATCHED_BEGIN_END"))
            .when(F.contains(m, F.lit("Expected")), F.lit("SYNTAX_EXPECTED"))
            .otherwise(F.lit("OTHER")))


# Spellings of an absent number
NO_NUMBER = ["", "—", "-", "N/A", "n/a"]


def parse_report_number(s) -> Column:
    """K11: '$1,234', '(234)', '-26.52%' → double.  Quotes and commas go, round
    brackets mean a negative number, one end's dollar signs and the other's percent
    signs go; anything else is null."""
    t = F.replace(F.regexp_replace(F.trim(c(s)), r'^"+|"+$', ""), F.lit(","), F.lit(""))
    negative = F.startswith(t, F.lit("(")) & F.endswith(t, F.lit(")"))
    core = F.regexp_replace(t, r"^[()]+|[()]+$", "")
    core = F.trim(F.regexp_replace(F.regexp_replace(core, r"^\$+", ""), "%+$", ""))
    number = F.when(F.regexp_like(core, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), core).try_cast("double")
    return F.when(t.isin(*NO_NUMBER), F.lit(None).cast("double")).otherwise(F.when(negative, -number).otherwise(number))


def safe_name(s) -> Column:
    """Every character other than letters, digits, '-' and '_' → '_'."""
    return F.regexp_replace(c(s), r"[^\p{L}\p{N}_-]", "_")


# The text for a script without the function, and the reference's bounds
NO_SUMMARY = "(無法擷取摘要)"
SUMMARY_LINES, SUMMARY_CHARS = 8, 300


def summarise_code(code, lines: int | None = None, clip: int | None = None) -> Column:
    """The non-blank lines of ``generate_signals`` up to the next method or
    class, joined by ' | '; a text above ``clip`` characters is cut there and marked."""
    body = F.regexp_extract(c(code), r"(?s)(def generate_signals.*?)(\n    def |\nclass |\z)", 1)
    ls = F.filter(F.transform(F.split(body, r"\r\n|\n|\r"), lambda l: F.regexp_replace(l, r"\s+\z", "")), lambda l: l != "")
    text = F.array_join(ls if lines is None else F.slice(ls, 1, lines), " | ")
    if clip is not None:
        text = F.concat(F.substring(text, 1, clip), F.when(F.length(text) > clip, "...").otherwise(""))
    return F.when(body == "", NO_SUMMARY).otherwise(text)


def effective_lines(code) -> Column:
    """Non-blank lines that are not ``//`` comments."""
    ls = F.transform(F.split(c(code), "\n"), lambda l: F.trim(l))
    return F.size(F.filter(ls, lambda l: (l != "") & ~F.startswith(l, F.lit("//"))))


# Declarations that a script must hold, by name in any case
DECLARATIONS = [("inputs", "inputs 宣告"), ("variables", "variables 宣告"), ("buy", "Buy 進場指令"), ("sell", "Sell Short 進場指令")]


def missing_declarations(code) -> Column:
    """Labels of the declarations that a script lacks, joined by ', ' ('' = none)."""
    low = F.lower(c(code))
    return F.concat_ws(", ", *[F.when(~F.contains(low, F.lit(word)), F.lit(label)) for word, label in DECLARATIONS])


# Labels of a failure record
RECORD_STRATEGY, RECORD_SUMMARY, RECORD_FAILED, RECORD_JOIN = "策略", "設計摘要", "失敗", "、"


def fail_record_text(date, kind, direction, timeframe, name, summary, reasons) -> Column:
    """One failure record: a heading with date, type, direction and timeframe,
    then strategy, summary and the reasons (an array)."""
    head = F.concat(F.lit("\n## "), F.date_format(c(date), "yyyy-MM-dd HH:mm"), F.lit(" "),
                    F.concat_ws(" / ", c(kind), c(direction), c(timeframe)), F.lit("\n"))
    line = lambda label, v: F.concat(F.lit(f"- {label}："), v, F.lit("\n"))
    return F.concat(head, line(RECORD_STRATEGY, c(name)), line(RECORD_SUMMARY, c(summary)),
                    line(RECORD_FAILED, F.array_join(c(reasons), RECORD_JOIN)))


# --------------------------------------------------------------------------
# pages
# --------------------------------------------------------------------------

# Heading and labels of the knowledge context
CONTEXT_HEADING, CONTEXT_TAGS, CONTEXT_NO_TAGS = "## 知識庫參考資料（使用者指定網址）\n", "標籤", "無"


def knowledge_context(records: DataFrame, tags: Sequence[str], max_urls: int = 8, max_chars: int = 3000,
                      order: str = "id") -> DataFrame:
    """One context per tag filter ('' = no filter): of the records whose tags hold
    the filter in any case, that have content and were fetched (an unknown state counts
    as fetched), the first ``max_urls`` by ``order``, clipped, under one heading; ''
    where there is none.  Records: id, url, title, tags, content, fetch_ok."""
    from pyspark.sql import Window
    want = F.explode(F.array(*map(F.lit, tags))).alias("tag_filter")
    usable = (F.coalesce("content", F.lit("")) != "") & F.coalesce("fetch_ok", F.lit(True))
    x = records.where(usable).select("*", want).where(
        F.contains(F.lower(F.coalesce("tags", F.lit(""))), F.lower("tag_filter")))
    # a filter's first records by a bounded aggregate: no window holds all of its records
    part = F.pmod(F.xxhash64(order), F.lit(256))
    near = Window.partitionBy("tag_filter", "_part").orderBy(order)
    x = x.withColumn("_part", part).withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= max_urls)
    w = Window.partitionBy("tag_filter").orderBy(order)
    x = x.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_urls)
    block = F.concat(F.lit("### ["), F.coalesce("title", "url"), F.lit("]("), F.col("url"), F.lit(f")\n{CONTEXT_TAGS}："),
                     F.coalesce("tags", F.lit(CONTEXT_NO_TAGS)), F.lit("\n"), F.substring("content", 1, max_chars), F.lit("\n"))
    g = x.groupBy("tag_filter").agg(F.count(F.lit(1)).alias("n_pages"), F.array_sort(F.collect_list(F.struct("_r", block.alias("b")))).alias("_l"))
    every = records.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(tags)], "tag_filter string")
    return every.join(g, "tag_filter", "left").select(
        "tag_filter", F.coalesce("n_pages", F.lit(0)).cast("long").alias("n_pages"),
        F.coalesce(F.concat(F.lit(CONTEXT_HEADING + "\n"), F.array_join(F.transform("_l", lambda e: e["b"]), "\n")), F.lit("")).alias("context"))


def url_host(url) -> Column:
    return F.lower(F.regexp_extract(c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))


def normalise_url(url) -> Column:
    u = F.lower(F.regexp_replace(c(url), r"#.*$", ""))
    return F.regexp_replace(u, r"/+$", "")


def dedup_pages(pages: DataFrame, order: str = "page_id", content: str = "text") -> DataFrame:
    """Keep a page unless an earlier page (by ``order``) has the same
    normalised URL or the same content hash.  First ids per hash come from
    partial aggregates (a hash shared by a huge number of copies still costs
    one row per task) joined back on the hash."""
    from barlake.session import materialize
    # the narrow (id, hashes) table is written once, so the text work feeding
    # it runs once for the two first-id aggregates and the join back
    x = materialize(pages.select(order, F.sha2(normalise_url("url"), 256).alias("url_hash"),
                                 F.sha2(F.col(content), 256).alias("content_hash")))
    fu = x.groupBy("url_hash").agg(F.min(order).alias("_fu"))
    fc = x.groupBy("content_hash").agg(F.min(order).alias("_fc"))
    y = x.join(fu, "url_hash").join(fc, "content_hash")
    return y.withColumn("keep", (F.col(order) == F.col("_fu")) & (F.col(order) == F.col("_fc"))).drop("_fu", "_fc")


def list_filter(pages: DataFrame, allow: DataFrame | None, deny: DataFrame | None) -> DataFrame:
    """Semi join on allowed domains, anti join on denied hosts (the join
    strategy is left to adaptive execution, which broadcasts a list only
    when its measured size is small)."""
    x = pages.withColumn("host", url_host("url"))
    x = x.withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))
    if allow is not None:
        x = x.join(allow, "domain", "left_semi")
    if deny is not None:
        x = x.join(deny, "host", "left_anti")
    return x
