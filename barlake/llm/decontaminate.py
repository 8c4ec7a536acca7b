"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are lower-cased and cut into word tokens.  Seeds, the runs
of ``MIN_MATCH`` tokens of the items, are looked up in every whole text; a document
and an item that share a seed are tiled: the longest run of tokens that is unmarked
in both is marked in both, again and again, until no run of ``MIN_MATCH`` tokens is
left.  Runs are found by running Karp-Rabin hashes at a falling search length and
verified token by token.  As tiles may lie in any order, a reordered passage scores
like a verbatim one.  An item is leaked if its tiles cover at least ``COVERAGE`` of
its tokens.

The items are sent to all tasks in slices of at most ``SLICE_TOKENS`` tokens, one
pass over the documents per slice, so no broadcast grows with the benchmark.
Documents are never shuffled: hot passages cost their own documents only.

Null and empty texts and items have no token and no leak; neither have items with
fewer than ``MIN_MATCH`` tokens.  Items that repeat an id count as one, by their best
coverage.  Repeated documents are reported row by row.  Empty tables give empty
results.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from barlake.llm.common import slices, written

#: Tokens of a seed and of the shortest tile.
MIN_MATCH = 5
#: Share of an item's tokens that tiles must cover.
COVERAGE = 0.5
#: Tokens of the benchmark that one pass carries.
SLICE_TOKENS = 500_000

_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_BASE = 0x9E3779B97F4A7C15
_WRAP = (1 << 64) - 1


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


# --- tiling ----------------------------------------------------------------------

def _hashes(ids: list[int], free: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """(start, hash) of every run of ``size`` unmarked tokens, by a rolling hash."""
    lead = pow(_BASE, size - 1, 1 << 64)
    value = length = 0
    for at, (x, ok) in enumerate(zip(ids, free)):
        if not ok:
            value = length = 0
            continue
        if length == size:
            value = (value - ids[at - size] * lead) & _WRAP
            length -= 1
        value = (value * _BASE + x) & _WRAP
        length += 1
        if length == size:
            yield at - size + 1, value


def _matches(a: list[int], free_a: list[bool], b: list[int], free_b: list[bool], size: int) -> list[tuple[int, int, int]]:
    """(length, start in a, start in b) of the maximal common unmarked runs of at
    least ``size`` tokens."""
    table: dict[int, list[int]] = {}
    for at, h in _hashes(b, free_b, size):
        table.setdefault(h, []).append(at)
    found = []
    for i, h in _hashes(a, free_a, size):
        for j in table.get(h, ()):
            if i and j and free_a[i - 1] and free_b[j - 1] and a[i - 1] == b[j - 1]:
                continue  # not maximal: the run that starts one earlier has it
            n = 0
            while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                n += 1
            if n >= size:
                found.append((n, i, j))
    return found


def tile(text: list[int], item: list[int], free_text: list[bool] | None = None,
         min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (length, start in text, start in item), longest first; ties go to the
    earliest start in the text, then in the item."""
    free_a = [True] * len(text) if free_text is None else list(free_text)
    free_b = [True] * len(item)
    tiles = []
    size = max(min_match, len(item) // 2)
    while True:
        found = _matches(text, free_a, item, free_b, size)
        longest = max(found, default=(0, 0, 0))[0]
        if longest:
            for n, i, j in sorted((m for m in found if m[0] == longest), key=lambda m: (m[1], m[2])):
                if all(free_a[i:i + n]) and all(free_b[j:j + n]):
                    free_a[i:i + n] = [False] * n
                    free_b[j:j + n] = [False] * n
                    tiles.append((n, i, j))
        elif size == min_match:
            return tiles
        else:
            size = max(min_match, size // 2)


# --- seeds -------------------------------------------------------------------------

class Index:
    """Tokens and seeds of a slice of the benchmark."""

    def __init__(self, items: list[tuple[int, list[str]]], min_match: int):
        self.min_match = min_match
        self.vocabulary: dict[str, int] = {}
        self.items = [(i, [self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in ts])
                      for i, ts in items if len(ts) >= min_match]
        codes, owner = [], []
        for k, (_, ids) in enumerate(self.items):
            own = np.unique(self.codes(np.array(ids, np.uint64)))
            codes.append(own)
            owner.append(np.full(len(own), k))
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.seeds = flat[order]
        self.owner = np.concatenate(owner)[order] if owner else np.zeros(0, np.int64)

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """Karp-Rabin codes of all runs of ``min_match`` token ids."""
        n = len(ids) - self.min_match + 1
        out = np.zeros(max(0, n), np.uint64)
        for k in range(self.min_match):
            out = out * np.uint64(_BASE) + ids[k:k + n] if n > 0 else out
        return out

    def leaks(self, words: list[str]) -> list[tuple[int, int, int, int]]:
        """(item id, covered tokens, item tokens, tiles) of the items that share a seed."""
        if len(words) < self.min_match or not len(self.seeds):
            return []
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, len(words))
        known = np.cumsum(np.concatenate([[0], ids != 0]))
        starts = np.flatnonzero(known[self.min_match:] - known[:-self.min_match] == self.min_match)
        if not len(starts):
            return []
        codes = self.codes(ids)[starts]
        lo, hi = np.searchsorted(self.seeds, codes, "left"), np.searchsorted(self.seeds, codes, "right")
        hit = hi > lo
        if not hit.any():
            return []
        places: dict[int, list[int]] = {}
        for at, a, b in zip(starts[hit].tolist(), lo[hit].tolist(), hi[hit].tolist()):
            for k in self.owner[a:b].tolist():
                places.setdefault(k, []).append(at)
        out = []
        for k, seeds in places.items():
            # only tokens under a seed can be part of a tile; runs of them are tiled
            near = sorted({at + d for at in seeds for d in range(self.min_match)})
            text, free = [], []
            for before, at in zip([-2, *near], near):
                if at != before + 1 and text:
                    text.append(0)
                    free.append(False)
                text.append(int(ids[at]))
                free.append(True)
            item_id, item = self.items[k]
            tiles = tile(text, item, free, self.min_match)
            out.append((item_id, sum(n for n, _, _ in tiles), len(item), len(tiles)))
        return out


def benchmark_slices(benchmark: DataFrame, item_id: str, text: str, slice_tokens: int) -> list[DataFrame]:
    """The benchmark in parts of about ``slice_tokens`` tokens (letters are counted,
    a token has one at least, so a part never holds more)."""
    items = written(benchmark.filter(F.col(text).isNotNull()).select(
        F.col(item_id).alias("item_id"), F.col(text).alias("text")), "items")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = 1 + size // slice_tokens
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) for k in range(parts)]


def leaked_pairs(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH,
                 coverage: float = COVERAGE, slice_tokens: int = SLICE_TOKENS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, item_id, covered, item_tokens, tiles, coverage) of the leaked items of each document."""
    spark = documents.sparkSession
    narrow = documents.select(F.col(id_col).alias("_id"), *carry, F.col(text).alias("_text"))
    kinds = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in narrow.schema.fields[:-1])
    item_type = benchmark.select(item_id).schema[0].dataType
    item_arrow = to_arrow_type(item_type)
    out = None
    for part in benchmark_slices(benchmark, item_id, item_text, slice_tokens):
        rows = [(r["item_id"], tokens(r["text"])) for r in part.collect()]
        index = spark.sparkContext.broadcast(Index(rows, min_match))

        def find(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "_text"):
                at, found = [], []
                for row, value in enumerate(batch.column("_text").to_pylist()):
                    best: dict[int, tuple[int, int, int]] = {}
                    for item, covered, size, tiles in index.value.leaks(tokens(value)):
                        if covered >= coverage * size and (item not in best or covered * best[item][1] > best[item][0] * size):
                            best[item] = (covered, size, tiles)
                    for item, (covered, size, tiles) in sorted(best.items(), key=lambda x: (x[0] is None, x[0])):
                        at.append(row)
                        found.append((item, covered, size, tiles))
                if found:
                    own = batch.take(pa.array(at))
                    cols = list(zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [*own.columns[:-1], pa.array(cols[0], item_arrow), *(pa.array(c, pa.int64()) for c in cols[1:])],
                        names=[*batch.schema.names[:-1], "item_id", "covered", "item_tokens", "tiles"])

        pairs = narrow.mapInArrow(find, f"{kinds}, item_id {item_type.simpleString()}, covered long, item_tokens long, tiles long")
        out = pairs if out is None else out.unionByName(pairs)
    return out.withColumn("coverage", F.col("covered") / F.col("item_tokens")).withColumnRenamed("_id", id_col)


def drop_leaked(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without a leaked item, with their columns unchanged; rows are
    told apart by id and text."""
    keyed = documents.withColumn("__tiling_text", F.xxhash64(text))
    bad = written(leaked_pairs(keyed, benchmark, id_col, text, carry=("__tiling_text",)).select(
        F.col(id_col).alias("__tiling_id"), F.col("__tiling_text").alias("__tiling_key")).distinct(), "leaked")
    return keyed.join(bad, F.col(id_col).eqNullSafe(F.col("__tiling_id")) & F.col("__tiling_text").eqNullSafe(F.col("__tiling_key")), "left_anti") \
        .drop("__tiling_text")
