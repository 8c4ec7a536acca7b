"""Removal of repeated 200-byte substrings, by column-wise construction.

1. Every text is cut at its anchors (``anchors.py``): a *piece* is an anchor with
   all starts of ``LENGTH``-byte strings that it is the anchor of, and the bytes
   these strings cover.  Each start lies in exactly one piece.
2. Spark counts the anchors; pieces whose anchor occurs once hold nothing that is
   repeated.  Of the others, equal pieces are collapsed to one with a count.
3. The bytes of the distinct pieces are fetched once, pieces of an anchor meet in
   one task, and collections of about ``COLLECTION_BYTES`` get a column-wise
   Burrows-Wheeler transform with common prefixes (``column_bwt.py``).  A start is
   repeated if its suffix shares ``LENGTH`` symbols with a neighbour, or its piece
   was counted twice.
4. Anchors with more than ``MAX_PIECES`` distinct pieces, too many for one task, have
   their strings counted one by one with a grouped count instead.
5. The starts go back to all pieces, ranges are joined to their texts, and the bytes
   under any repeated string are removed.

Texts are known by two 64-bit hashes, so equal texts share one set of ranges.
Matches never cross documents, and all is judged on the input.  Null texts are
empty; texts below ``LENGTH`` bytes keep everything.  Repeated rows repeat each
other: their text goes, if long enough.  Empty tables give empty results.  Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm import anchors
from barlake.llm.column_bwt import repeated_starts
from barlake.llm.common import byte_texts, slices, written

LENGTH = 200
#: Bytes of the pieces that one transform is built over.
COLLECTION_BYTES = 8 << 20
#: Distinct pieces of an anchor that one task takes.
MAX_PIECES = 100_000


def _keys(text: Column) -> list[Column]:
    """Two hashes that name a text."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t, F.lit(2)).alias("k2")]


# --- pieces -------------------------------------------------------------------------

# A shape packs the anchor's offset in a piece and the piece's number of starts.
_STARTS_BITS = 9


def pieces(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, body, shape, k1, k2, firsts): all pieces of all texts; ``body`` hashes
    the bytes, ``shape`` packs anchor offset and number of starts, ``firsts`` lists
    where the piece occurs in the text (a text of one word over and over is one row)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 1 << 20):
            columns: list[tuple] = []
            for row, text in enumerate(byte_texts(batch, "_text")):
                h, position, first, last = anchors.find(text, length)
                if not len(h):
                    continue
                stop = last + length
                body = np.fromiter((xxhash.xxh64_intdigest(text[a:b]) for a, b in zip(first.tolist(), stop.tolist())),
                                   np.uint64, len(h))
                shape = (position - first) << _STARTS_BITS | (last - first + 1)
                order = np.lexsort((first, shape, body, h))
                h, body, shape, first = h[order], body[order], shape[order], first[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (body[1:] != body[:-1]) | (shape[1:] != shape[:-1])])
                size = np.diff(np.append(np.flatnonzero(new), len(h)))
                columns.append((h[new].view(np.int64), body[new].view(np.int64), shape[new], np.full(len(size), row), size, first))
            if columns:
                h, body, shape, row, size = (np.concatenate(c) for c in zip(*(c[:5] for c in columns)))
                firsts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)),
                                                  pa.array(np.concatenate([c[5] for c in columns])))
                own = batch.select(["k1", "k2"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(body), pa.array(shape.astype(np.int32)), *own.columns, firsts],
                    names=["anchor", "body", "shape", "k1", "k2", "firsts"])

    return docs.select("_text", "k1", "k2").mapInArrow(
        cut, "anchor long, body long, shape int, k1 long, k2 long, firsts array<long>")


def anchor_counts(docs: DataFrame, length: int) -> DataFrame:
    """(anchor): the anchors that occur twice or more; tasks count their own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 16 << 20):
            found = [anchors.find(t, length)[0] for t in byte_texts(batch, "_text")]
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], names=["anchor", "n"])

    return docs.select("_text").mapInArrow(count, "anchor long, n int").groupBy("anchor").agg(
        F.sum("n").alias("n")).filter("n > 1").select("anchor")


def piece_bytes(docs: DataFrame, distinct: DataFrame, length: int) -> DataFrame:
    """(anchor, body, shape, n, bytes) for the distinct pieces: they are gathered per
    text that lends them, and that text is read once."""
    wanted = distinct.groupBy("lend.k1", "lend.k2").agg(F.collect_list(F.struct(
        "anchor", "body", "shape", "n", F.col("lend.first").alias("first"))).alias("wanted"))
    texts = _lenders(docs).join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in slices(batches, "packed", 1 << 20):
            out: list[tuple] = []
            for packed, items in zip(batch.column("packed").to_pylist(), batch.column("wanted").to_pylist()):
                text = unpack.decompress(packed)
                for w in items:
                    stop = w["first"] + (w["shape"] & ((1 << _STARTS_BITS) - 1)) + length - 1
                    out.append((w["anchor"], w["body"], w["shape"], w["n"], text[w["first"]:stop]))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()),
                     pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary())],
                    names=["anchor", "body", "shape", "n", "bytes"])

    return texts.select("packed", "wanted").mapInArrow(cut, "anchor long, body long, shape int, n long, bytes binary")


def _lenders(docs: DataFrame) -> DataFrame:
    """(k1, k2, packed): every text at least once, and once per task at most, so that
    a text with many copies is no burden to the join that follows."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame = zstandard.ZstdCompressor(level=3)
        seen: set[tuple[int, int]] = set()
        for batch in slices(batches, "_text"):
            rows = []
            for row, key in enumerate(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist())):
                if key not in seen:
                    seen.add(key)
                    rows.append(row)
            own = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [own.column("k1"), own.column("k2"), pa.array([frame.compress(t) for t in byte_texts(own, "_text")], pa.binary())],
                names=["k1", "k2", "packed"])

    return docs.select("k1", "k2", "_text").mapInArrow(first, "k1 long, k2 long, packed binary")


def _packed() -> Column:
    """The text as a compressed frame, for the shuffles that carry it."""

    @F.pandas_udf("binary")
    def pack(texts):
        frame = zstandard.ZstdCompressor(level=3)
        return texts.map(lambda t: frame.compress((t or "").encode("utf-8")))

    return pack(F.col("_text")).alias("packed")


# --- verdicts ---------------------------------------------------------------------------

_VERDICT = "anchor long, body long, shape int, mask binary"


def _judge(length: int, budget: int):
    """Masks of repeated starts, over collections of whole anchors from a partition
    that is sorted by anchor."""

    def masks(held: list[tuple]) -> pa.RecordBatch:
        found = repeated_starts([h[4] for h in held], [h[2] >> _STARTS_BITS for h in held], [h[3] for h in held], length)
        return pa.RecordBatch.from_arrays(
            [pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()),
             pa.array([h[2] for h in held], pa.int32()), pa.array([np.packbits(f).tobytes() for f in found], pa.binary())],
            names=["anchor", "body", "shape", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in slices(batches, "bytes", 1 << 20):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= budget and row[0] != held[-1][0]:
                    yield masks(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield masks(held)

    return run


def _counted(rows: DataFrame, length: int) -> DataFrame:
    """Masks for anchors with too many pieces: their strings are counted by hash."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", 1 << 17):
            for anchor, body, shape, n, text in zip(*(c.to_pylist() for c in batch.columns)):
                starts = range(len(text) - length + 1)
                hashes = [xxhash.xxh3_128_digest(text[i:i + length]) for i in starts]
                k = len(hashes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([anchor] * k, pa.int64()), pa.array([body] * k, pa.int64()), pa.array([shape] * k, pa.int32()),
                     pa.array([n] * k, pa.int64()), pa.array(list(starts), pa.int32()), pa.array(hashes, pa.binary())],
                    names=["anchor", "body", "shape", "n", "at", "string"])

    strings = written(rows.mapInArrow(explode, "anchor long, body long, shape int, n long, at int, string binary"), "strings")
    again = strings.groupBy("string").agg(F.sum("n").alias("copies")).filter("copies > 1").select("string")
    hits = strings.join(again, "string", "left_semi").groupBy("anchor", "body", "shape").agg(F.collect_list("at").alias("at"))

    @F.pandas_udf("binary")
    def mask(shape, at):
        out = []
        for s, own in zip(shape, at):
            bits = np.zeros(s & ((1 << _STARTS_BITS) - 1), bool)
            bits[np.asarray(own, np.int64)] = True
            out.append(np.packbits(bits).tobytes())
        import pandas as pd
        return pd.Series(out)

    return hits.select("anchor", "body", "shape", mask("shape", "at").alias("mask"))


def repeated_ranges(docs: DataFrame, length: int, collection_bytes: int, max_pieces: int) -> DataFrame:
    """(k1, k2, parts): per text the masks of its pieces that hold a repeated start."""
    rare_free = written(anchor_counts(docs, length), "anchors")
    # no aggregate in the stage of this join: Spark can then split a hot anchor
    found = written(pieces(docs, length).join(rare_free, "anchor", "left_semi"), "pieces")
    distinct = written(found.groupBy("anchor", "body", "shape").agg(
        F.sum(F.size("firsts").cast("long")).alias("n"),
        F.min(F.struct("k1", "k2", F.col("firsts")[0].alias("first"))).alias("lend")), "distinct")
    large = written(distinct.groupBy("anchor").agg(F.count("*").alias("d")).filter(F.col("d") > max_pieces).select("anchor"), "large")
    held = written(piece_bytes(docs, distinct, length), "bytes")
    judged = held.join(large, "anchor", "left_anti").select("anchor", "body", "shape", "n", "bytes") \
        .repartition("anchor").sortWithinPartitions("anchor", "body", "shape").mapInArrow(_judge(length, collection_bytes), _VERDICT)
    crowded = _counted(held.join(large, "anchor", "left_semi").select("anchor", "body", "shape", "n", "bytes"), length)
    verdicts = written(judged.unionByName(crowded).filter(F.regexp_replace(F.hex("mask"), "0", "") != ""), "verdicts")
    return found.join(verdicts, ["anchor", "body", "shape"]).groupBy("k1", "k2").agg(
        F.collect_set(F.struct("firsts", "shape", "mask")).alias("parts"))


def removed_runs(n_bytes: int, parts: list[dict], length: int) -> np.ndarray:
    """Boolean mask of the bytes under a repeated string."""
    edge = np.zeros(n_bytes + 1, np.int32)
    for p in parts:
        starts = np.flatnonzero(np.unpackbits(np.frombuffer(p["mask"], np.uint8))[:p["shape"] & ((1 << _STARTS_BITS) - 1)])
        for first in p["firsts"]:
            edge[starts + first] += 1
            edge[starts + first + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def with_removal(df: DataFrame, text: str, columns: list[str], compute, schema: str, length: int = LENGTH,
                 collection_bytes: int = COLLECTION_BYTES, max_pieces: int = MAX_PIECES) -> DataFrame:
    """``columns`` of every row, and what ``compute(text bytes, removed mask)`` makes."""
    if not anchors.ANCHOR <= length <= 255:
        raise ValueError(f"length must lie in {anchors.ANCHOR}..255")
    docs = df.select(F.col(text).alias("_text"), *_keys(F.col(text)))
    ranges = written(repeated_ranges(docs, length, collection_bytes, max_pieces), "ranges")
    full = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.col(text).alias("_text"), *_keys(F.col(text)))
    kept = [f"c{i}" for i in range(len(columns))]
    joined = full.select(*kept, "k1", "k2", _packed()).join(ranges, ["k1", "k2"], "left").select(*kept, "packed", "parts")
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in slices(batches, "packed", 1 << 20):
            out = []
            for packed, parts in zip(batch.column("packed").to_pylist(), batch.column("parts").to_pylist()):
                raw = unpack.decompress(packed)
                out.append(compute(raw, removed_runs(len(raw), parts, length) if parts else None))
            made = pa.Table.from_pylist([dict(zip(names, o)) for o in out], schema=arrow).to_batches()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *made[0].columns], names=[*kept, *names])

    arrow = pa.schema([(c.strip().split(" ")[0], {"long": pa.int64(), "string": pa.string()}[c.strip().split(" ")[1]])
                       for c in schema.split(",")])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema.fields[:-2])
    out = joined.mapInArrow(run, f"{kinds}, {schema}")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], *names)


def _kept(raw: bytes, removed: np.ndarray | None) -> bytes:
    return raw if removed is None else np.frombuffer(raw, np.uint8)[~removed].tobytes()


def _digest(raw: bytes, removed: np.ndarray | None) -> tuple:
    if removed is None:
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest()
    spans = int(np.count_nonzero(np.diff(removed.astype(np.int8), prepend=0) == 1))
    return len(raw), int(removed.sum()), spans, hashlib.sha256(_kept(raw, removed)).hexdigest()


def _rest(raw: bytes, removed: np.ndarray | None) -> tuple:
    # a cut inside a character leaves bytes that are no text; they go as well
    return (_kept(raw, removed).decode("utf-8", "ignore"),)


def dedup_digests(df: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, **bounds) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256."""
    return with_removal(df, text, [id_col], _digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string",
                        length, **bounds)


def dedup_texts(df: DataFrame, text: str = "text", length: int = LENGTH, **bounds) -> DataFrame:
    """All rows and columns, with the repeated bytes gone from the text; a null text
    becomes empty."""
    others = [c for c in df.columns if c != text]
    return with_removal(df, text, others, _rest, "__kept_text string", length, **bounds).withColumnRenamed("__kept_text", text) \
        .select(*df.columns)
