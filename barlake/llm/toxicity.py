"""Toxic spans by a linear-chain conditional random field.

Labels mark documents, so the token labels come from a contrast: over a bounded
sample of the labelled training rows (``SAMPLE_DOCUMENTS`` of each label) Spark
counts, per word and word prefix, the toxic and the other documents that hold it and
the variety of words before it.  A unit is toxic if
nearly all its documents are, the contrast is significant, and it follows many
different words (text copied from one toxic document fails that).  Words with a
toxic unit, in toxic documents, are labelled 1, all other words 0.  Where no single word
is toxic, the tokens of the field are pairs: each word with the one before it on its
line, contrasted and labelled the same way; a toxic pair's span holds both words.

The field has two states per word.  Its emissions are hashed features of the word
(the word, prefixes, a suffix, its shape), its transitions are free.  It is trained
by gradient ascent on a bounded sample of ``SAMPLE_SEQUENCES`` sequences.  A
sequence is a piece of up to ``SEQUENCE_WORDS`` words of a line; every word of a text
is in one.

Scoring runs forward-backward over all sequences of a batch side by side.  A
document's score is a logistic function, fitted on a bounded sample of training
rows, of the highest word marginal and the expected number of toxic words.  Words
whose marginal is at least one half form the offending spans, as character offsets.

Null, empty and wordless texts have the score of a text without a toxic word.
Repeated rows are scored one by one.  Without a labelled toxic training row, or where
neither words nor pairs tell the labels apart, every score is the share of toxic
training rows (0 without any row).  Documents with
several labels count as toxic if one label is 1.  Other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import slices, written
from barlake.llm.langid import held_out

#: The learning sample: labelled documents of each label, and sequences of each label
#: cut from them, both as the expected number of a choice by hash.
SAMPLE_DOCUMENTS = 15_000
SAMPLE_SEQUENCES = 6_000
#: Documents of each label that the final score is fitted on.
FIT_DOCUMENTS = 3_000
SEQUENCE_WORDS = 128
#: Contrast: share of toxic documents, G statistic, different words before.
MIN_SHARE = 0.9
MIN_G = 20.0
MIN_CONTEXTS = 4
#: Toxic units that a model may hold.
MAX_UNITS = 20_000
#: Hashed features, gradient steps, step size, penalty.
FEATURES = 1 << 18
STEPS = 60
RATE = 0.2
PENALTY = 1e-3
#: Entries of the tables that a task keeps.
TABLE_WORDS = 400_000

_WORD = re.compile(r"\w+")
_PREFIXES = (3, 4, 5, 6)


def _words(text: str) -> list[str]:
    return _WORD.findall(text)


def _units(word: str) -> list[str]:
    """The word and its prefixes of four letters and more, in lower case."""
    w = word.lower()
    return [w + "$"] if " " in w else [w + "$", *(w[:n] for n in _PREFIXES if 4 <= n <= len(w))]


def sequences(words: list[str], lines: list[int]) -> list[tuple[int, int]]:
    """(start, stop) of the pieces of up to ``SEQUENCE_WORDS`` words of each line."""
    out = []
    at = 0
    for n in lines:
        for start in range(at, at + n, SEQUENCE_WORDS):
            out.append((start, min(at + n, start + SEQUENCE_WORDS)))
        at += n
    return out


def _split(text: str | None, pairs: bool = False) -> tuple[list[str], list[int]]:
    """Words of a text (or each with the word before it) and their number on each line."""
    per_line = [_words(line) for line in (text or "").split("\n")]
    if pairs:
        per_line = [[f"{a} {b}" for a, b in zip(["", *ws], ws)] for ws in per_line]
    return [w for ws in per_line for w in ws], [len(ws) for ws in per_line]


# --- learning: toxic units -----------------------------------------------------

def unit_contrast(rows: DataFrame, pairs: bool = False) -> DataFrame:
    """(unit, bad, good, contexts) over rows of (text, toxic): documents of either
    label that hold the unit, and a 64-bit sketch of the words before it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            if found:
                bad, good, seen = zip(*found.values())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.string()), pa.array(bad, pa.int64()), pa.array(good, pa.int64()),
                     pa.array(np.array(seen, np.uint64).view(np.int64))], names=["unit", "bad", "good", "seen"])
            found.clear()

        for batch in slices(batches, "text"):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words, _ = _split(text, pairs)
                own: dict[str, int] = {}
                for before, word in zip(["", *words], words):
                    bit = 1 << (zlib.crc32(before.encode()) & 63)
                    own[word] = own.get(word, 0) | bit
                units: dict[str, int] = {}
                for word, bits in own.items():
                    for u in _units(word):
                        units[u] = units.get(u, 0) | bits
                for u, bits in units.items():
                    entry = found.setdefault(u, [0, 0, 0])
                    entry[0 if toxic else 1] += 1
                    if toxic:
                        entry[2] |= bits
            if len(found) > TABLE_WORDS:
                yield from flush()
        yield from flush()

    partial = rows.select("text", "toxic").mapInArrow(count, "unit string, bad long, good long, seen long")
    return partial.groupBy("unit").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"),
                                       F.bit_count(F.bit_or("seen")).alias("contexts"))


@dataclass
class Sample:
    """A written table of (text, toxic), the chosen share of each label's rows, and
    the share of toxic rows among all."""
    rows: DataFrame
    chosen: tuple[float, float]
    base: float
    counts: tuple[int, int]


def _chosen(key: Column, share: float) -> Column:
    """True for about ``share`` of the keys, by hash."""
    return F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20) + 0.5)


def draw_sample(documents: DataFrame, labels: DataFrame, id_col: str, text: str) -> Sample:
    """The documents of about ``SAMPLE_DOCUMENTS`` labels at most of each kind outside
    the held-out part, chosen by their id.  The chosen ids have that bound, so they
    are broadcast and no text is shuffled."""
    marks = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col), 5, 0)) \
        .groupBy(id_col).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    shares = tuple(min(1.0, SAMPLE_DOCUMENTS / max(1, n.get(label, 0))) for label in (0, 1))
    picked = marks.filter(F.when(F.col("toxic") > 0, _chosen(F.col(id_col), shares[1])).otherwise(_chosen(F.col(id_col), shares[0])))
    rows = documents.select(id_col, F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(picked), id_col)
    total = n.get(0, 0) + n.get(1, 0)
    return Sample(written(rows.select("text", "toxic"), "sample"), shares, n.get(1, 0) / total if total else 0.0,
                  (n.get(0, 0), n.get(1, 0)))


def toxic_units(sample: Sample, pairs: bool = False) -> list[str]:
    """The toxic units, at most ``MAX_UNITS`` by count."""
    bad, good = F.col("bad") / sample.chosen[1], F.col("good") / sample.chosen[0]
    n = F.col("bad") + F.col("good")
    held = [c * s for c, s in zip(sample.counts, sample.chosen)]
    base = held[1] / (held[0] + held[1])
    g = 2 * (F.col("bad") * F.log(F.col("bad") / (n * base))
             + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (n * (1 - base)))).otherwise(0.0))
    top = unit_contrast(sample.rows, pairs).filter((F.col("bad") > 0) & (F.col("contexts") >= MIN_CONTEXTS)) \
        .filter((bad >= (bad + good) * MIN_SHARE) & (g >= MIN_G)).orderBy(F.desc("bad"), "unit").limit(MAX_UNITS)
    return [r["unit"] for r in top.select("unit").collect()]


# --- the field ------------------------------------------------------------------

def feature_names(word: str) -> list[str]:
    w = word.lower()
    shape = "X" if word.isupper() else "Xx" if word[:1].isupper() else "9" if word[:1].isdigit() else "x"
    return ["w" + w, "s" + w[-3:], "c" + shape, *("p" + w[:n] for n in _PREFIXES if n <= len(w))]


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % FEATURES


def feature_ids(word: str) -> list[int]:
    return [_bucket(x) for x in feature_names(word)]


@dataclass
class Field:
    """Weights of state 1 against state 0, and log transitions."""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    bias: float = -4.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    #: Logistic over (log odds of the top marginal, log(1 + expected toxic words)); or a constant.
    score: tuple[float, float, float] = (0.0, 0.0, 0.0)
    constant: float | None = None
    #: Tokens are pairs of words.
    pairs: bool = False
    #: Weights by name of the features that many words share.
    seen: dict[str, float] = field(default_factory=dict)

    def emission(self, word: str) -> float:
        names = feature_names(word)
        seen = self.seen
        if len(seen) > TABLE_WORDS:
            seen.clear()
        total = self.bias + float(self.weights[_bucket(names[0])])
        for name in names[1:]:
            weight = seen.get(name)
            if weight is None:
                weight = seen[name] = float(self.weights[_bucket(name)])
            total += weight
        return total


_LIMIT = 1e30


def forward_backward(emission: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward odds, backward odds and exp emissions of padded sequences (rows sorted
    by falling length); odds are of state 1 against state 0."""
    t = np.exp(moves)
    e = np.exp(np.clip(emission, -60, 60))
    rows, width = e.shape
    alive = [int(np.searchsorted(-lengths, -at, side="left")) for at in range(width + 1)]  # rows longer than at
    r = np.zeros_like(e)
    b = np.ones_like(e)
    for at in range(width):
        n = alive[at]
        r[:n, at] = e[:n, at] if at == 0 else np.clip(
            e[:n, at] * (t[0, 1] + r[:n, at - 1] * t[1, 1]) / (t[0, 0] + r[:n, at - 1] * t[1, 0]), 1 / _LIMIT, _LIMIT)
    for at in range(width - 2, -1, -1):
        n = alive[at + 1]
        x = e[:n, at + 1] * b[:n, at + 1]
        b[:n, at] = np.clip((t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x), 1 / _LIMIT, _LIMIT)
    return r, b, e


def marginals(emission: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    r, b, _ = forward_backward(emission, lengths, moves)
    odds = r * b
    return odds / (1 + odds)


def train(examples: list[tuple[list[str], list[int]]]) -> Field:
    """Gradient ascent on the log likelihood of labelled sequences."""
    f = Field()
    examples = sorted((x for x in examples if x[0]), key=lambda x: -len(x[0]))
    if not examples:
        return f
    lengths = np.array([len(w) for w, _ in examples])
    width = int(lengths[0])
    inside = np.arange(width)[None, :] < lengths[:, None]
    y = np.zeros(inside.shape)
    y[inside] = np.concatenate([np.array(labels, float) for _, labels in examples])
    table: dict[str, int] = {}
    word_at = np.array([table.setdefault(w, len(table)) for words, _ in examples for w in words])
    ids = [feature_ids(w) for w in table]
    flat, owner = np.concatenate(ids), np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    pairs = inside[:, 1:]
    observed = np.array([[(pairs * (y[:, :-1] == i) * (y[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    size = inside.sum()
    memory = [np.zeros(FEATURES), 0.0, np.zeros((2, 2))]
    for _ in range(STEPS):
        emission = np.zeros(inside.shape)
        emission[inside] = (f.bias + np.bincount(owner, f.weights[flat], len(table)))[word_at]
        r, b, e = forward_backward(emission, lengths, f.moves)
        odds = r * b
        gap = (y - odds / (1 + odds))[inside]
        t = np.exp(f.moves)
        x = e[:, 1:] * b[:, 1:]
        joint = np.stack([np.ones_like(x) * t[0, 0], t[0, 1] * x, r[:, :-1] * t[1, 0], r[:, :-1] * t[1, 1] * x])
        joint = (joint / joint.sum(axis=0) * pairs).sum(axis=(1, 2)).reshape(2, 2)
        by_word = np.bincount(word_at, gap, len(table))
        grads = [np.bincount(flat, by_word[owner], FEATURES) - PENALTY * f.weights, gap.sum(), observed - joint]
        for k, g in enumerate(grads):
            memory[k] = memory[k] + g * g
            step = RATE * g / (np.sqrt(memory[k]) + 1e-6 * size ** 0.5)
            if k == 0:
                f.weights = f.weights + step
            elif k == 1:
                f.bias += float(step)
            else:
                f.moves = f.moves + step
    return f


# --- learning: sample and fit ----------------------------------------------------

def sample_sequences(rows: DataFrame, units: list[str], pairs: bool = False) -> list[tuple[list[str], list[int]]]:
    """About ``SAMPLE_SEQUENCES`` sequences at most with a toxic word and as many
    without, chosen by the hash of their words."""
    shared = rows.sparkSession.sparkContext.broadcast(frozenset(units))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic_of: dict[str, int] = {}
        for batch in slices(batches, "text"):
            out: list[tuple[str, str, int]] = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words, lines = _split(text, pairs)
                for w in set(words):
                    if w not in toxic_of:
                        toxic_of[w] = int(any(u in shared.value for u in _units(w)))
                labels = [toxic_of[w] if toxic else 0 for w in words]
                for lo, hi in sequences(words, lines):
                    out.append(("\n".join(words[lo:hi]), "".join(map(str, labels[lo:hi])), int(1 in labels[lo:hi])))
            if len(toxic_of) > TABLE_WORDS:
                toxic_of.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["words", "labels", "hit"])

    cuts = written(rows.select("text", "toxic").mapInArrow(cut, "words string, labels string, hit long")
                   .filter((F.col("hit") == 1) | _chosen(F.col("words"), 0.125)), "sequences")
    found = {r["hit"]: r["n"] for r in cuts.groupBy("hit").agg(F.count("*").alias("n")).collect()}
    out = []
    for hit in (1, 0):
        share = min(1.0, SAMPLE_SEQUENCES / max(1, found.get(hit, 0)))
        picked = cuts.filter((F.col("hit") == hit) & _chosen(F.reverse("words"), share))
        out += [(r["words"].split("\n"), [int(c) for c in r["labels"]]) for r in picked.select("words", "labels").collect()]
    return sorted(out)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Newton steps for a weighted, penalised logistic regression of two inputs."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(3)
        w = w + np.linalg.solve(h, a.T @ (weight * (y - p)) - 1e-2 * w)
    return float(w[0]), float(w[1]), float(w[2])


def learn(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> Field:
    """The field from the labelled documents outside the held-out part."""
    sample = draw_sample(documents, labels, id_col, text)
    if sample.base in (0.0, 1.0):
        return Field(constant=sample.base)
    pairs = False
    units = toxic_units(sample)
    if not units:
        pairs = True
        units = toxic_units(sample, pairs)
    if not units:
        return Field(constant=sample.base)
    f = train(sample_sequences(sample.rows, units, pairs))
    f.pairs = pairs
    shares = [min(1.0, FIT_DOCUMENTS / max(1.0, c * s)) for c, s in zip(sample.counts, sample.chosen)]
    few = sample.rows.filter(F.when(F.col("toxic") > 0, _chosen(F.reverse("text"), shares[1])).otherwise(_chosen(F.reverse("text"), shares[0])))
    seen = tagged(few.withColumn("_id", F.col("toxic").cast("long")), f, "_id", "text") \
        .select("_id", "top_odds", "expected").toPandas().sort_values(["_id", "top_odds", "expected"])
    y = seen["_id"].to_numpy(float)
    # rows stand for all labelled rows of their label
    weight = np.where(y > 0, 1 / (shares[1] * sample.chosen[1]), 1 / (shares[0] * sample.chosen[0]))
    f.score = _logistic(seen[["top_odds", "expected"]].to_numpy(), y, weight / weight.mean())
    return f


# --- tagging -----------------------------------------------------------------------

SPANS = "array<struct<start:int,stop:int,score:double>>"


def tagged(df: DataFrame, f: Field, id_col: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: id, carried columns, score, top_odds, expected, spans."""
    shared = df.sparkSession.sparkContext.broadcast(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known: dict[str, int] = {}
        table = np.zeros(1024)
        for batch in slices(batches, "_text"):
            texts = batch.column("_text").to_pylist()
            if len(known) > TABLE_WORDS:
                known = {}
            codes, owner, starts, stops = [], [], [], []
            at = 0
            for row, value in enumerate(texts):
                words, lines = _split(value, m.pairs)
                for w in set(words):
                    if w not in known:
                        if len(known) == len(table):
                            table = np.concatenate([table, np.zeros_like(table)])
                        table[len(known)] = m.emission(w)
                        known[w] = len(known)
                codes.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
                for lo, hi in sequences(words, lines):
                    owner.append(row)
                    starts.append(at + lo)
                    stops.append(at + hi)
                at += len(words)
            p = np.zeros(at)
            flat = table[np.concatenate(codes)] if codes else np.zeros(0)
            lo, hi = np.array(starts, np.int64), np.array(stops, np.int64)
            order = np.argsort(lo - hi, kind="stable")
            for part in range(0, len(order), 4096):
                pick = order[part:part + 4096]
                lengths = (hi - lo)[pick]
                cols = np.arange(int(lengths[0]))
                inside = cols[None, :] < lengths[:, None]
                index = (lo[pick][:, None] + cols[None, :])[inside]
                emission = np.zeros(inside.shape)
                emission[inside] = flat[index]
                p[index] = marginals(emission, lengths, m.moves)[inside]
            top, total, spans = [], [], []
            at = 0
            for value, code in zip(texts, codes):
                own = p[at:at + len(code)]
                at += len(code)
                best = float(own.max()) if len(own) else 0.0
                top.append(min(12.0, max(-12.0, math.log((best + 1e-12) / (1 - best + 1e-12)))))
                total.append(math.log1p(float(own[own > 0.05].sum())))
                spans.append(_spans(value, own, m.pairs) if best >= 0.5 else [])
            a, b, c = m.score
            odds = a + b * np.array(top, float) + c * np.array(total, float)
            score = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) if m.constant is None else np.full(len(texts), m.constant)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(score, pa.float64()),
                 pa.array(top, pa.float64()), pa.array(total, pa.float64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())])))],
                names=[*batch.schema.names[:-1], "score", "top_odds", "expected", "spans"])

    narrow = df.select(F.col(id_col).alias("_id"), *carry, F.col(text).alias("_text"))
    kinds = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in narrow.schema.fields[:-1])
    return narrow.mapInArrow(run, f"{kinds}, score double, top_odds double, expected double, spans {SPANS}") \
        .withColumnRenamed("_id", id_col)


def _spans(text: str, p: np.ndarray, pairs: bool = False) -> list[dict]:
    """Runs of toxic words as character offsets, with their highest marginal."""
    if pairs:  # a pair's marginal holds for the word before it too
        first = np.cumsum([0, *_split(text)[1]])[:-1]
        after = np.append(p[1:], 0.0)
        after[first[first > 0] - 1] = 0.0
        p = np.maximum(p, after[:len(p)])
    out: list[dict] = []
    last = -2
    offset = 0
    n = 0
    for line in text.split("\n"):
        for match in _WORD.finditer(line):
            if p[n] >= 0.5:
                if last == n - 1:
                    out[-1]["stop"] = offset + match.end()
                    out[-1]["score"] = max(out[-1]["score"], float(p[n]))
                else:
                    out.append({"start": offset + match.start(), "stop": offset + match.end(), "score": float(p[n])})
                last = n
            n += 1
        offset += len(line) + 1
    return out


def score_documents(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, held_out, score, predicted, spans."""
    held = held_out(F.col(id_col), 5, 0)
    f = learn(documents, labels, id_col, text)
    out = tagged(documents.withColumn("__toxicity_held", held), f, id_col, text, ("__toxicity_held",))
    return out.select(id_col, F.col("__toxicity_held").alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
