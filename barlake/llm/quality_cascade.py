"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

A text is split into words and lines once; each rule is a boolean expression over the
text, its words and its lines.  The cascade measures every rule on a bounded sample
(seconds beyond the split, in the form that the query runs, and share of rows
rejected), orders the rules by rejection per cost and nests them in one CASE: a row
that one rule rejects is never shown to the later ones.  The order only changes the
work, never the verdict, which is "no rule rejects".  The filter orders the base among
the rules; the rows that state the base features have to compute those for every text.

Null texts have no words and count as empty; empty texts have zero in every
feature.  Repeated rows are judged one by one.  An empty table gives an empty
result with the same columns.  Input columns keep their names; the features are
built from expressions, so an input column called like a feature does not clash.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import SEPARATORS, drop, let, scratch, words_of

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Words of a window whose repetition marks boilerplate.
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PCT = 20
#: Rows of the sample that cost and selectivity are estimated on.
SAMPLE_ROWS = 2000


# --- features -------------------------------------------------------------

def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(_text(text), SEPARATORS, "")).cast("long")


def n_symbols(text: Column) -> Column:
    t = _text(text)
    return (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long")


def _lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(_text(text), "\n"), lambda x: F.translate(x, SEPARATORS, "") != "")


def n_dup_lines(text: Column) -> Column:
    return let(_lines(text), lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long")


def _repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside a window of ``window`` words that the text holds twice or more."""

    def windows(w: Column) -> Column:
        hashes = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, window)]))
        return F.slice(hashes, 1, F.greatest(F.size(w) - (window - 1), F.lit(0)))

    def starts(s: Column) -> Column:
        n = F.size(s)
        hit = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.when(
            F.when(k > 0, F.get(s, k - 1)["h"] == F.get(s, k)["h"]).otherwise(False)
            | F.when(k < n - 1, F.get(s, k + 1)["h"] == F.get(s, k)["h"]).otherwise(False),
            F.get(s, k)["i"]).otherwise(-1))
        return F.array_sort(F.array_remove(hit, -1))

    def covered(at: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        return F.aggregate(at, zero, lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])

    def judged(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(
            let(ranked, lambda s: covered(starts(s))))

    return let(windows(words), judged).cast("long")


def _stutter_words(words: Column) -> Column:
    """Words that the next word repeats."""
    return F.size(F.filter(words, lambda x, i: x == F.get(words, i + 1))).cast("long")


def n_repeat_words(text: Column, window: int = WINDOW) -> Column:
    return let(words_of(text), lambda w: _repeat_words(w, window))


class Features:
    """Feature columns of a text, each an expression of its own, so that a rule
    pays only for what it uses."""

    def __init__(self, text: Column):
        self.text = _text(text)
        self.n_words = n_words(text)
        self.word_chars = word_chars(text)
        self.n_symbols = n_symbols(text)
        self.n_dup_lines = n_dup_lines(text)
        self.n_lines = F.size(_lines(text)).cast("long")
        self.n_repeat_words = n_repeat_words(text)
        self.n_stutter_words = let(words_of(text), _stutter_words)


class Split(Features):
    """The same features over words and lines that are bound once (``split``); what no
    rule asks for is never computed."""

    def __init__(self, q: Column):
        self.text = q.getField("text")
        words, lines = q.getField("w"), q.getField("l")
        self.n_words = F.size(words).cast("long")
        self.word_chars = F.length(F.translate(self.text, SEPARATORS, "")).cast("long")
        self.n_symbols = (F.length(self.text) - F.length(F.translate(self.text, SYMBOLS, ""))).cast("long")
        self.n_lines = F.size(lines).cast("long")
        self.n_dup_lines = (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")
        self.n_repeat_words = _repeat_words(words)
        self.n_stutter_words = _stutter_words(words)


def split(text: Column, body: Callable[[Split], Column]) -> Column:
    """``body`` over the features of a text that is split once."""
    parts = F.struct(_text(text).alias("text"), words_of(text).alias("w"), _lines(text).alias("l"))
    return let(parts, lambda q: body(Split(q)))


# --- rules ----------------------------------------------------------------

@dataclass(frozen=True)
class Rule:
    """``rejects`` maps the features of a text to a boolean, true for bad texts."""
    name: str
    rejects: Callable[[Features], Column]


def _capitals(f: Features) -> Column:
    """More than half of the letters are capitals."""
    capitals = F.length(F.regexp_replace(f.text, "\\P{Lu}+", ""))
    return capitals * 2 > F.length(F.regexp_replace(f.text, "\\P{L}+", ""))


def _shouting(f: Features) -> Column:
    """More than one doubled exclamation mark in ten words."""
    doubled = F.length(f.text) - F.length(F.replace(f.text, F.lit("!!"), F.lit("!")))
    return doubled * 100 > f.n_words * 10


def _few_letters(f: Features) -> Column:
    """Less than half of the characters of the words are letters or marks."""
    return F.length(F.regexp_replace(f.text, "[^\\p{L}\\p{M}]+", "")) * 2 < f.word_chars


RULES: tuple[Rule, ...] = (
    Rule("symbol_rate", lambda f: f.n_symbols * 100 > f.n_words * 10),
    Rule("duplicate_lines", lambda f: f.n_dup_lines * 100 > f.n_lines * 50),
    Rule("stutter", lambda f: f.n_stutter_words * 100 > f.n_words * 30),
    Rule("shouting", _shouting),
    Rule("capitals", _capitals),
    Rule("few_letters", _few_letters),
)

BASE = Rule("base", lambda f: (f.n_words < MIN_WORDS) | (f.n_repeat_words * 100 > f.n_words * MAX_REPEAT_PCT))


# --- cascade --------------------------------------------------------------

@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def rank(self) -> float:
        return self.rejected / max(self.seconds, 1e-4)


def measure(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text",
            sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> list[Measured]:
    """Time each rule over a sample of about ``sample_rows`` rows and count its
    rejections; only these two numbers per rule reach the driver."""
    spark = df.sparkSession
    rows = df.count()
    if rows == 0:
        return [Measured(r, 0.0, 0.0) for r in rules]
    path = scratch(spark, "sample")
    df.select(F.col(text).alias("text")).sample(False, min(1.0, sample_rows / rows), seed).coalesce(8).write.parquet(path)
    sample = spark.read.parquet(path)

    def timed(expr: Column) -> tuple[float, float]:
        job = sample.agg(F.avg(expr.cast("double")).alias("share"))
        began = time.perf_counter()
        share = job.first()["share"] or 0.0
        return time.perf_counter() - began, share

    bare = split(F.col("text"), lambda f: (f.n_words + f.n_lines) > 0)
    timed(bare)
    idle = min(timed(bare) for _ in range(2))[0]
    found = []
    for r in rules:
        seconds, share = min(timed(split(F.col("text"), r.rejects)) for _ in range(2))
        found.append(Measured(r, max(0.0, seconds - idle), share))
    drop(spark, path)
    return found


def cascade(ordered: Sequence[Rule], features: Features) -> tuple[Column, Column]:
    """(kept, name of the first rule that rejects) as CASE expressions that stop
    at the first rejection."""
    kept: Column | None = None
    first: Column | None = None
    for r in ordered:
        bad = F.coalesce(r.rejects(features), F.lit(False))
        kept = F.when(bad, False) if kept is None else kept.when(bad, False)
        first = F.when(bad, r.name) if first is None else first.when(bad, r.name)
    if kept is None or first is None:
        return F.lit(True), F.lit(None).cast("string")
    return kept.otherwise(True), first


def ordered_rules(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text",
                  sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by falling rejection per second; ties keep the given order."""
    found = measure(df, rules, text, sample_rows)
    return [m.rule for m in sorted(found, key=lambda m: -m.rank)]


def quality_rows(df: DataFrame, id_col: str = "doc_id", text: str = "text",
                 rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per document: id, the base features, ``base_failed`` and ``kept``."""
    order = ordered_rules(df, rules, text)
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def row(f: Split) -> Column:
        def judged(known: Column) -> Column:
            for name in base:       # what the row states is not computed again
                setattr(f, name, known.getField(name))
            failed = BASE.rejects(f)
            return F.struct(*[known.getField(name).alias(name) for name in base], failed.alias("base_failed"),
                            F.when(failed, False).otherwise(cascade(order, f)[0]).alias("kept"))

        return let(F.struct(*[getattr(f, name).alias(name) for name in base]), judged)

    return df.select(id_col, split(F.col(text), row).alias("__quality")).select(id_col, "__quality.*")


def quality_filter(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows that pass the base and every rule, with their columns unchanged."""
    order = ordered_rules(df, [BASE, *rules], text)
    return df.filter(split(F.col(text), lambda f: cascade(order, f)[0]))
