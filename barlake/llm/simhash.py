"""SimHash near-duplicates with bit-sliced comparison.

Texts are lower-cased (A-Z), cut into words and 4-word shingles, and every shingle
is hashed with XXH64 (seed 42).  A fingerprint bit is set where over half of the
hashes have it.  Fingerprints that differ in at most ``RADIUS`` bits are linked.

Equal fingerprints are collapsed first.  For the others the 64 bits are cut into
``BLOCKS`` blocks; two fingerprints within the radius agree on at least
``BLOCKS - RADIUS`` of them, so each combination of that many blocks is a bucket key
and no link is lost.  A bucket is compared in bit-sliced form: its 64 bit planes lie
in machine words of 64 candidates each; the planes' differences from one fingerprint
are added by carry-save counters, most of the bits of all candidates at a time, and
a block of candidates is abandoned once every distance in it is over the radius.
Buckets above ``TILE`` rows are cut into tiles that meet pairwise, in tasks of their
own.  A comparison emits a spanning forest of its links, never all pairs, and the
components of the links are found with joins.

Texts without a word (null, empty) have fingerprint zero and are linked like any
other.  Repeated rows fall into one class.  A null id takes part but never names a
component unless the component has no other id.  Empty tables give empty results.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import byte_texts, slices, written
from barlake.llm.components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
BITS = 64
#: Blocks of the fingerprint: more blocks make longer keys, smaller buckets, and
#: more of them.  Six give 15 keys of 21 bits, apt for some ten million classes;
#: eight give 70 keys of 32 bits for billions.
BLOCKS = 6
#: Rows of a bucket that one comparison holds.
TILE = 1024
#: Buckets up to this many rows are compared many at a time.
FEW = 48
#: Candidates (in 64-bit words) of a block that is abandoned as one.
ABANDON_WORDS = 16
#: Planes that are added between two looks at the distances.
STRIDE = 8

_SHIFTS = np.arange(63, -1, -1, dtype=np.uint64)


# --- fingerprints ----------------------------------------------------------------

def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[k:] for k in range(shingle)))))
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(grams), 8192):
        part = grams[at:at + 8192]
        h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in part), np.uint64, len(part))
        votes += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = votes * 2 > len(grams)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp, key): ``fp`` holds the fingerprint's 64 bits in a signed long, ``key``
    is a hash of the text that tells rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            fp = np.array([fingerprint(t, shingle) for t in byte_texts(batch, "_text")], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(fp.view(np.int64)), batch.column("key")], names=["_id", "fp", "key"])

    narrow = df.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("key"))
    kind = narrow.schema["_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"_id {kind}, fp long, key long").withColumnRenamed("_id", id_col)


# --- bit-sliced comparison ---------------------------------------------------------

class Planes:
    """Fingerprints stored vertically: plane ``i`` holds bit ``i`` of 64 candidates
    per machine word."""

    def __init__(self, fps: np.ndarray):
        self.size = len(fps)
        padded = np.zeros(-(-max(1, len(fps)) // 64) * 64, np.uint64)
        padded[:len(fps)] = fps
        bits = ((padded[None, :] >> _SHIFTS[:, None]) & np.uint64(1)).astype(np.uint8)
        self.planes = np.packbits(bits, axis=1, bitorder="little").view("<u8")

    def within(self, fp: int, radius: int, start: int = 0) -> np.ndarray:
        """Candidates from ``start`` on at ``radius`` or fewer bits from ``fp``."""
        first = start // 64 // ABANDON_WORDS * ABANDON_WORDS
        blocks = [(lo, min(lo + ABANDON_WORDS, self.planes.shape[1]))
                  for lo in range(first, self.planes.shape[1], ABANDON_WORDS)]
        live = np.concatenate([np.arange(lo, hi) for lo, hi in blocks]) if blocks else np.zeros(0, np.int64)
        width = int(radius + 1).bit_length()
        # counters saturate: once a distance is over the radius its ``over`` bit stays
        count = [np.zeros(len(live), np.uint64) for _ in range(width)]
        over = np.zeros(len(live), np.uint64)
        flip = [np.uint64(0xFFFFFFFFFFFFFFFF) if fp >> (63 - i) & 1 else np.uint64(0) for i in range(BITS)]
        for base in range(0, BITS, STRIDE):
            for i in range(base, base + STRIDE, 2):
                a, b = self.planes[i][live] ^ flip[i], self.planes[i + 1][live] ^ flip[i + 1]
                # carry-save: two planes and the ones counter give a sum and a carry
                half = a ^ b
                carry = (a & b) | (half & count[0])
                count[0] = half ^ count[0]
                for k in range(1, width):
                    count[k], carry = count[k] ^ carry, count[k] & carry
                over |= carry | _above(count, radius)
            if base + STRIDE < BITS and len(live):
                groups = live // ABANDON_WORDS
                edge = np.flatnonzero(np.diff(groups, prepend=-1))
                open_group = np.bitwise_or.reduceat(~over, edge) != 0
                if not open_group.all():
                    keep = np.repeat(open_group, np.diff(np.append(edge, len(live))))
                    live, over, count = live[keep], over[keep], [c[keep] for c in count]
                    if not len(live):
                        break
        if not len(live):
            return np.zeros(0, np.int64)
        hits = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        word, bit = np.nonzero(hits)
        found = live[word] * 64 + bit
        return found[(found >= start) & (found < self.size)]


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits set where the counters hold more than ``radius``."""
    equal = ~np.zeros_like(count[0])
    more = np.zeros_like(count[0])
    for k in range(len(count) - 1, -1, -1):
        if radius >> k & 1:
            equal &= count[k]
        else:
            more |= equal & count[k]
            equal &= ~count[k]
    return more


def forest(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Spanning links of ``left`` (against itself, or against ``right``) as
    fingerprint pairs: a link that joins two linked groups is kept, others not."""
    fps = left if right is None else np.concatenate([left, right])
    planes = Planes(fps)
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for i in range(len(left)):
        for j in planes.within(int(fps[i]), radius, i + 1 if right is None else len(left)).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                links.append((int(fps[i]), int(fps[j])))
    return links


# --- links on Spark --------------------------------------------------------------------

def _block_masks(blocks: int) -> list[int]:
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << (BITS - b) for a, b in zip(edges, edges[1:])]


def bucket_keys(classes: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(combo, key, fp): one row per combination of ``blocks - radius`` blocks."""
    if blocks <= radius:
        raise ValueError("there must be more blocks than differing bits")
    masks = [sum(c) for c in combinations(_block_masks(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    entries = F.array(*[F.struct(F.lit(i).alias("combo"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                        for i, m in enumerate(signed)])
    return classes.select("fp", F.explode(entries).alias("k")).select("k.combo", "k.key", "fp")


def links(classes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all that are within
    the radius of each other."""
    keyed = written(bucket_keys(classes, radius, blocks), "buckets")
    sizes = keyed.groupBy("combo", "key").agg(F.count("*").alias("n")).filter("n > 1")
    large = written(sizes.filter(F.col("n") > tile).withColumn("tiles", F.ceil(F.col("n") / tile)), "large")
    part = F.xxhash64("combo", "key")
    small = keyed.join(large.select("combo", "key"), ["combo", "key"], "left_anti").select(
        "combo", "key", "fp").repartition(part).sortWithinPartitions("combo", "key", "fp") \
        .mapInArrow(_compare_sorted(radius), "a long, b long")
    # a large bucket: every row goes to the tile pairs that its own tile is part of
    own = keyed.join(large, ["combo", "key"]).withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")))
    paired = own.select("combo", "key", "fp", "tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other")) \
        .select("combo", "key", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "fp")

    def pair(key: tuple, table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        of = table.column("tile").to_numpy()
        lo, hi = key[2].as_py(), key[3].as_py()
        found = forest(fp, None, radius) if lo == hi else forest(fp[of == lo], fp[of == hi], radius)
        a = np.array([x for x, _ in found], np.uint64).view(np.int64)
        b = np.array([y for _, y in found], np.uint64).view(np.int64)
        return pa.table({"a": a, "b": b})

    tiled = paired.groupBy("combo", "key", "lo", "hi").applyInArrow(pair, "a long, b long")
    return small.unionByName(tiled)


def _few_forests(fps: np.ndarray, stop: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning links inside many small buckets at once; ``stop`` gives for each row
    the end of its bucket.  The differences of row pairs are compared with zero."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found = []
    left = np.arange(len(fps))
    step = 1
    while len(left := left[left + step < stop[left]]):
        for at in range(0, len(left), 1 << 16):
            own = left[at:at + (1 << 16)]
            near = own[Planes(fps[own] ^ fps[own + step]).within(0, radius)]
            for i in near.tolist():
                a, b = root(i), root(i + step)
                if a != b:
                    parent[b] = a
                    found.append((int(fps[i]), int(fps[i + step])))
        step += 1
    return found


def _compare_sorted(radius: int):
    """Compare the buckets of a partition that is sorted by (combo, key)."""

    def bucket_links(rows: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
        size = np.diff(np.append(starts, len(rows)))
        few = np.repeat((size > 1) & (size <= FEW), size)
        stops = np.repeat(np.cumsum(np.where((size > 1) & (size <= FEW), size, 0)), size)[few]
        found = _few_forests(rows[few], stops, radius)
        for lo, n in zip(starts[size > FEW].tolist(), size[size > FEW].tolist()):
            found += forest(rows[lo:lo + n], None, radius)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            found = bucket_links(rows, starts) if len(rows) else []
            if found:
                ab = np.array(found, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

        held: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            cols = (batch.column("combo").to_numpy(), batch.column("key").to_numpy(),
                    batch.column("fp").to_numpy().view(np.uint64))
            if held is not None:
                cols = tuple(np.concatenate([h, c]) for h, c in zip(held, cols))
            if not len(cols[0]):
                continue
            new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
            starts = np.concatenate([[0], new])
            last = starts[-1]  # the last bucket may go on in the next batch
            yield from out(cols[2][:last], starts[:-1])
            held = tuple(c[last:] for c in cols)
        if held is not None:
            yield from out(held[2], np.array([0]))

    return run


def classes_of(docs: DataFrame, id_col: str) -> DataFrame:
    """(fp, rank): distinct fingerprints; ranks are unique and order the classes by
    their smallest id, classes without an id last."""
    return docs.groupBy("fp").agg(F.min(id_col).alias("id")).select(
        "fp", F.struct(F.col("id").isNull().alias("missing"), F.col("id"), F.col("fp")).alias("rank"))


def grouped(df: DataFrame, id_col: str, text: str, shingle: int, radius: int, blocks: int) -> DataFrame:
    """(id, fp, key, group): ``group`` is the smallest rank that the document reaches."""
    docs = written(fingerprints(df, id_col, text, shingle), "fingerprints")
    classes = written(classes_of(docs, id_col), "classes")
    found = components(classes, links(classes, radius, blocks), "fp", "rank")
    named = written(classes.join(found, "fp", "left").select("fp", F.coalesce("label", "rank").alias("group")), "named")
    return docs.join(named, "fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Per document: id, fingerprint (16 hex digits), component_id."""
    return grouped(df, id_col, text, shingle, radius, blocks).select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("group")["id"].alias("component_id"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
               radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """One document of each group, with its columns unchanged: the one with the
    smallest id (null last), among equal ids the one with the smallest text hash,
    among equal rows any."""
    order = F.struct(F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("id"), F.col("key"))
    leads = written(grouped(df, id_col, text, shingle, radius, blocks).groupBy("group").agg(F.min(order).alias("lead"))
                    .select(F.col("lead.id").alias("__simhash_id"), F.col("lead.key").alias("__simhash_key")).distinct(), "leads")
    keyed = df.withColumn("__simhash_text", F.xxhash64(text))
    kept = keyed.join(leads, F.col(id_col).eqNullSafe(F.col("__simhash_id")) & (F.col("__simhash_text") == F.col("__simhash_key")), "left_semi")
    return kept.dropDuplicates([id_col, "__simhash_text"]).drop("__simhash_text")
