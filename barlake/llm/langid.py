"""Language identification: words first, then ever shorter character n-grams.

A known word scores by its log frequency in each language.  An unknown word is
covered from the left by its longest known n-gram (``MAX_GRAM`` characters down to
one), each scored the same way; a character that no n-gram covers scores the floor
in every language.  A language that lacks a unit scores the table's floor, which is
one for all languages and below every score of a known unit, so a language gains
nothing from a small training set.  Words are the runs of letters and marks of the
lower-cased text.  The text's language has the highest sum; ``score`` is its share of the
languages' posterior, with the sum of log odds tempered by the word count.

Learning counts the words of every labelled training row: tasks count their own
rows first, Spark sums the counts per (language, word), and the n-gram counts come
from the summed words.  The model keeps the most frequent of each language, up to
``TOP_WORDS`` and ``TOP_GRAMS``, so its size is bounded by the number of languages.

With many languages the model's units are shared evenly (``MAX_UNITS``).  Of more than
``MAX_LANGUAGES`` languages those with the most training words are learnt; documents in
one of the others can't be labelled with it.

Null texts and texts without a letter (marks alone are none) are ``und`` with score 0.  Ties go to the
language that sorts first.  Without a training row every text is ``und``.
Repeated rows count as often as they occur.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.llm.common import slices, written

TOP_WORDS = 20_000
TOP_GRAMS = 20_000
MAX_GRAM = 5
#: Languages that a model may hold, and its words (and n-grams) over all languages:
#: many languages share them evenly.
MAX_LANGUAGES = 1_000
MAX_UNITS = 1_000_000
UNKNOWN = "und"
#: Words that a task counts before it hands them on, and scores that it keeps.
TABLE_WORDS = 400_000
TABLE_SCORES = 2_000_000

_WORD = regex.compile(r"[\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def _words(text: str | None) -> list[str]:
    return [w for w in _WORD.findall(text.lower()) if w] if text else []


def word_counts(df: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, word, n) over all rows: counted in the tasks, then summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for key, c in seen.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(c), pa.string()), pa.array(list(c), pa.string()),
                     pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])
            seen.clear()

        for batch in slices(batches, "_text"):
            for key, value in zip(batch.column("_lang").to_pylist(), batch.column("_text").to_pylist()):
                seen.setdefault(key, Counter()).update(_words(value))
            if sum(map(len, seen.values())) > TABLE_WORDS:
                yield from flush()
        yield from flush()

    partial = df.select(F.col(lang).alias("_lang"), F.col(text).alias("_text")).mapInArrow(
        count, "lang string, word string, n long")
    return partial.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """(lang, gram, n): n-grams of one to ``MAX_GRAM`` characters inside words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for key, c in seen.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(c), pa.string()), pa.array(list(c), pa.string()),
                     pa.array(list(c.values()), pa.int64())], names=["lang", "gram", "n"])
            seen.clear()

        for batch in slices(batches, "word", 1 << 20):
            for key, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                c = seen.setdefault(key, Counter())
                for size in range(1, MAX_GRAM + 1):
                    for at in range(len(word) - size + 1):
                        c[word[at:at + size]] += n
            if sum(map(len, seen.values())) > TABLE_WORDS:
                yield from flush()
        yield from flush()

    return words.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _top(counts: DataFrame, unit: str, limit: int) -> list[tuple[str, str, int, int]]:
    """(lang, unit, n, n of the whole language) of the most frequent units: all that
    reach the smallest count that at most ``limit`` units of the language reach.
    The cut comes from the number of units per count, so no task ranks a language's
    units; units that tie at the cut go together.  Where the highest count alone is
    shared by more than ``limit`` units, ``limit`` of those stay, in hash order."""
    same = counts.groupBy("lang", "n").agg(F.count("*").alias("units"))
    falling = Window.partitionBy("lang").orderBy(F.desc("n"))
    cut = same.withColumn("reach", F.sum("units").over(falling)) \
        .withColumn("total", F.sum(F.col("n") * F.col("units")).over(Window.partitionBy("lang"))) \
        .groupBy("lang").agg(F.min(F.when(F.col("reach") <= limit, F.col("n"))).alias("cut"), F.max("total").alias("total"),
                             F.max("n").alias("most"), F.max_by("units", "n").alias("ties"))
    cuts = cut.collect()  # one row per language learnt
    if not cuts:
        return []
    rows = counts.join(F.broadcast(counts.sparkSession.createDataFrame(cuts, cut.schema)), "lang")
    top = rows.filter("n >= cut").select("lang", unit, "n", "total")
    if any(r["cut"] is None for r in cuts):
        # a slot has about one unit, so the slots that are ranked hold about twice the limit
        slot = F.pmod(F.xxhash64(unit), F.col("ties"))
        tied = rows.filter("cut is null and n = most").withColumn("slot", slot).filter(F.col("slot") < 2 * limit + 16)
        ranked = tied.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("slot", unit)))
        top = top.unionByName(ranked.filter(F.col("rank") <= limit).select("lang", unit, "n", "total"))
    return [tuple(r) for r in top.collect()]


class Model:
    """Bounded tables of log frequencies: unit -> one score per language.  A table's
    floor halves the frequency of a unit seen once in its largest language."""

    def __init__(self, words: list[tuple], grams: list[tuple]):
        self.languages = sorted({r[0] for r in [*words, *grams]})
        at = {k: i for i, k in enumerate(self.languages)}
        self.words = self._table(words, at)
        self.grams = self._table(grams, at)
        self.floor = self._floor(grams)

    @staticmethod
    def _floor(rows: list[tuple]) -> float:
        return -math.log(2 * max((r[3] for r in rows), default=1))

    def _table(self, rows: list[tuple], at: dict[str, int]) -> tuple[list[float], dict[str, list[tuple[int, float]]]]:
        """What every language scores that lacks a unit, and the others' scores by unit."""
        low = [self._floor(rows)] * len(self.languages)
        out: dict[str, list[tuple[int, float]]] = {}
        for key, unit, n, whole in rows:
            out.setdefault(unit, []).append((at[key], math.log(n / whole)))
        return low, out

    @staticmethod
    def _scores(table: tuple[list[float], dict[str, list[tuple[int, float]]]], unit: str) -> list[float] | None:
        low, units = table
        own = units.get(unit)
        if own is None:
            return None
        out = list(low)
        for i, score in own:
            out[i] = score
        return out

    def score(self, word: str) -> list[float]:
        """Scores of a word in every language: the word itself, or n-grams."""
        known = self._scores(self.words, word)
        if known is not None:
            return known
        sums = [0.0] * len(self.languages)
        at = 0
        while at < len(word):
            for size in range(min(MAX_GRAM, len(word) - at), 0, -1):
                gram = self._scores(self.grams, word[at:at + size])
                if gram is not None:
                    sums = [a + b for a, b in zip(sums, gram)]
                    break
            else:
                size = 1
                sums = [a + self.floor for a in sums]
            at += size
        return sums


def learn(df: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """Model of the rows of ``df`` whose ``lang`` is not null."""
    rows = df.filter(F.col(lang).isNotNull())
    words = written(word_counts(rows, lang, text), "words")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("size")).orderBy(F.desc("size"), "lang").limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        kept = words.sparkSession.createDataFrame([(r["lang"],) for r in sizes[:MAX_LANGUAGES]], "lang string")
        words = words.join(F.broadcast(kept), "lang")
    share = MAX_UNITS // max(1, min(len(sizes), MAX_LANGUAGES))
    return Model(_top(words, "word", min(TOP_WORDS, share)), _top(gram_counts(words), "gram", min(TOP_GRAMS, share)))


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text",
            held_out: Column | None = None) -> DataFrame:
    """Per document: id, held_out, lang_pred, score."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        m = shared.value
        known: dict[str, int] = {}
        table = np.zeros((1024, max(1, len(m.languages))))
        most = TABLE_SCORES // max(1, len(m.languages))
        for batch in slices(batches, "_text"):
            found, scores = [], []
            for value in batch.column("_text").to_pylist():
                words = _words(value)
                if not words or not m.languages or not _LETTER.search(value):
                    found.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                if len(known) > most:
                    known = {}
                for w in set(words):
                    if w not in known:
                        if len(known) == len(table):
                            table = np.concatenate([table, np.zeros_like(table)])
                        table[len(known)] = m.score(w)
                        known[w] = len(known)
                total = table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(axis=0)
                best = int(total.argmax())
                odds = np.exp((total - total[best]) / math.sqrt(len(words)))
                found.append(m.languages[best])
                scores.append(float(1 / odds.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_held"), pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                names=["_id", "held_out", "lang_pred", "score"])

    held = F.lit(False) if held_out is None else held_out
    narrow = df.select(F.col(id_col).alias("_id"), F.coalesce(held, F.lit(False)).alias("_held"), F.col(text).alias("_text"))
    kind = narrow.schema["_id"].dataType.simpleString()
    return narrow.mapInArrow(judge, f"_id {kind}, held_out boolean, lang_pred string, score double") \
        .withColumnRenamed("_id", id_col)


def held_out(id_col: Column, parts: int, part: int) -> Column:
    """True where crc32 of the id's text falls in ``part`` of ``parts`` (a null id: false)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the rows outside the held-out quarter, then predict every row."""
    held = held_out(F.col(id_col), 4, 2)
    return predict(df, learn(df.filter(~held), lang, text), id_col, text, held)
