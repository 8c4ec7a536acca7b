"""Spelling variants: words one edit apart, found by scans over sorted word lists.

A list of words is sorted, and a query walks it in order.  It keeps the rows of its
edit matrix, three cells wide, one row per character of the current word; the next
word takes over the rows of the prefix that it shares with the one before (their
LCP).  When all cells of a row exceed one edit, all words that share the prefix up
to that row are skipped.

Which words are in one list: the first character where two near words differ lies in
the first half of the shorter word or behind it, so near words share a half.  Each
word goes to the lists of both halves, as a shorter and as a longer partner; lists
of a shared second half hold the words reversed, so that the shared part leads.  A
list of more than ``GROUP`` words is cut again by halving the interval in which the
first difference lies: its words share the rest.  At an interval of one character a
list has at most some 8 200 words, as the alphabet is limited.  A pair counts only in
the list whose interval holds its first difference, so it counts once.

Null texts have no words; a null id is read as the empty text in the damage.  Repeated
rows count each.  Ties go to the smaller word.  An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import byte_texts, drop, scratch, slices, written

#: Shortest word, fewest occurrences, and how much oftener a form occurs.
MIN_LENGTH = 7
MIN_COUNT = 2
FORM_RATIO = 10
#: One in so many words of a document loses a character.
DAMAGE = 31
#: Words of a list that is scanned as it is.
GROUP = 256
#: Words that a task counts before it sends them on.
HELD = 1 << 17
#: Tables of long lists up to this many rows are broadcast; larger ones join by shuffle.
BROADCAST_LISTS = 500_000


def _tallies(batches):
    """(word, n) partial counts of the damaged words of (_id, _text) batches."""
    import pyarrow as pa

    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % MIN_LENGTH)
    held: Counter = Counter()

    def sent():
        out = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
        held.clear()
        return out

    for batch in slices(batches, "_text"):
        for name, text in zip(batch.column("_id").to_pylist(), byte_texts(batch, "_text")):
            lead = zlib.crc32(f"{name or ''}:".encode())
            for word, n in Counter(runs.findall(text.lower().decode())).items():
                h = zlib.crc32(word.encode(), lead)
                if h % DAMAGE == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1:]
                    if len(word) < MIN_LENGTH:
                        continue
                held[word] += n
            if len(held) > HELD:
                yield sent()
    if held:
        yield sent()


def vocabulary(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of all texts and how often they occur."""
    rows = df.select(F.col(id_col).cast("string").alias("_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(_tallies, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _with_key(rows: DataFrame) -> DataFrame:
    """Adds the list of a row: what is equal outside of the interval [lo, hi)."""
    longer = (F.length("word") > F.col("base")).cast("int")
    head = F.expr("substring(word, 1, lo)")
    tail = F.substring("word", F.col("hi") + longer + 1, F.length("word"))
    return rows.withColumn("key", F.xxhash64("base", "lo", "hi", head, tail))


def _halves(base: Column) -> Column:
    half = F.floor(base / 2).cast("int")
    return F.array(F.struct(base.alias("base"), F.lit(0).alias("lo"), half.alias("hi")),
                   F.struct(base.alias("base"), half.alias("lo"), (base + 1).alias("hi")))


def _lists(words: DataFrame, group: int) -> DataFrame:
    """(key, base, lo, hi, word, n): the lists to scan, none too long."""
    size = F.length("word").cast("int")
    shortest = F.lit(1)
    parts = F.concat(_halves(size), F.when(size > shortest, _halves(size - 1)).otherwise(F.array().cast(
        "array<struct<base:int,lo:int,hi:int>>")))
    level = _with_key(words.withColumn("part", F.explode(parts)).select("word", "n", "part.base", "part.lo", "part.hi"))
    done = None
    while True:
        long = written(level.filter("hi - lo > 1").groupBy("key").agg(F.count("*").alias("size"))
                       .filter(F.col("size") > group).select("key"), "lists")
        count = long.count()
        if not count:
            return level if done is None else done.unionByName(level)
        small = F.broadcast(long) if count <= BROADCAST_LISTS else long
        short = level.join(small, "key", "left_anti")
        done = short if done is None else done.unionByName(short)
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        cut = F.array(F.struct("lo", mid.alias("hi")), F.struct(mid.alias("lo"), "hi"))
        level = _with_key(level.join(small, "key", "left_semi").withColumn("part", F.explode(cut)).select(
            "word", "n", "base", "part.lo", "part.hi"))


def _shared(a: str, b: str) -> int:
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return i
    return min(len(a), len(b))


def scan(texts: list[str], base: int):
    """Pairs (a, b) of places in the sorted list, text ``a`` of ``base`` characters
    and text ``b`` of as many or one more, that are exactly one edit apart."""
    size = len(texts)
    lcp = [0, *(_shared(texts[i - 1], texts[i]) for i in range(1, size))]
    common = min([base, *lcp[1:]])
    lcp[0] = common
    longest = base + 2
    for a, text in enumerate(texts):
        if len(text) != base:
            continue
        query = "\0" + text + "\0\0\0"
        # row d: the edits from the word's first d characters to d - 1, d and d + 1 of the query's
        rows = [(2 if common == 0 else 1, 0, 1)] * (common + 1) + [(2, 2, 2)] * (longest - common)
        depth, b = common, 0
        while b < size:
            word = texts[b]
            d = depth if depth < lcp[b] else lcp[b]
            less, same, more = rows[d]
            dead = False
            for d in range(d, len(word)):
                c = word[d]
                if c == query[d]:
                    less = less if less <= same else same + 1
                else:
                    less = (less if less < same else same) + 1
                if c != query[d + 1]:
                    same += 1
                if less < same:
                    same = min(same, less + 1)
                if more < same:
                    same = min(same, more + 1)
                if c != query[d + 2]:
                    more += 1
                if same < more:
                    more = min(more, same + 1)
                rows[d + 1] = (less, same, more)
                if less > 1 and same > 1 and more > 1:
                    dead = True
                    break
            if dead:
                depth = d + 1
                b += 1
                while b < size and lcp[b] > d:
                    b += 1
                continue
            depth = len(word)
            if (same if len(word) == base else less) == 1:
                yield a, b
            b += 1


def _scanned(batches):
    """Partial (word, near, best_n, best) of the lists in batches sorted by key and text."""
    import numpy as np
    import pyarrow as pa

    out: list[tuple] = []

    def solve(rows):
        base, lo, hi = rows[0][1], rows[0][2], rows[0][3]
        near, best = [0] * len(rows), [(0, "")] * len(rows)

        def meet(x, y):
            near[x] += 1
            offer = (-rows[y][5], rows[y][4])
            if best[x] == (0, "") or offer < best[x]:
                best[x] = offer

        for a, b in scan([row[6] for row in rows], base):
            if lo <= _shared(rows[a][4], rows[b][4]) < hi:
                meet(a, b)
                if len(rows[b][4]) > base:
                    meet(b, a)
        out.extend((row[4], c, -n, w) for row, c, (n, w) in zip(rows, near, best) if c)

    def sent():
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        batch = pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)],
                                           ["word", "near", "best_n", "best"])
        out.clear()
        return batch

    names = ["key", "base", "lo", "hi", "word", "n", "sorted"]
    kept: list[tuple] = []
    for batch in batches:
        keys = batch.column("key").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        rows = None
        for lo, hi in zip(cuts, cuts[1:]):
            if kept and kept[0][0] != keys[lo]:
                if len(kept) > 1:
                    solve(kept)
                kept = []
            if hi - lo > 1 or kept or hi == len(keys):
                if rows is None:
                    rows = list(zip(*(batch.column(name).to_pylist() for name in names)))
                kept += rows[lo:hi]
        if len(out) > 10_000:
            yield sent()
    if len(kept) > 1:
        solve(kept)
    if out:
        yield sent()


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, n_near, best): for each word with a near one how many there are, and the
    most frequent of them (ties: the smallest) as (n, word)."""
    lists = _lists(words.select("word", "n"), group)
    ordered = F.when(F.col("lo") == 0, F.reverse("word")).otherwise(F.col("word"))
    rows = lists.withColumn("sorted", ordered).select("key", "base", "lo", "hi", "word", "n", "sorted")
    found = rows.repartition("key").sortWithinPartitions("key", "base", "lo", "hi", "sorted") \
        .mapInArrow(_scanned, "word string, near long, best_n long, best string")
    least = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), least.alias("least")).select(
        "word", "n_near", F.struct((-F.col("least.n")).alias("n"), F.col("least.word").alias("word")).alias("best"))


def _roots(formed: DataFrame) -> DataFrame:
    """(word, root) of the words with a form.  Counts grow tenfold along a chain, so
    chains are short and pointer jumping ends after a few rounds."""
    spark = formed.sparkSession
    at = scratch(spark, "roots")
    formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")).write.parquet(at)
    while True:
        links = spark.read.parquet(at)
        far = links.select(F.col("word").alias("root"), F.col("root").alias("far"))
        path = scratch(spark, "roots")
        links.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"),
                                               F.col("far").isNotNull().alias("moved")).write.parquet(path)
        drop(spark, at)
        at = path
        if not spark.read.parquet(at).filter("moved").limit(1).count():
            return spark.read.parquet(at).select("word", "root")


def variant_groups(words: DataFrame, group: int = GROUP, ratio: int = FORM_RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n)."""
    near = near_words(words, group)
    is_form = F.col("best.n") >= ratio * F.col("n")
    formed = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, F.col("best.n")).alias("form_n")), "formed")
    return formed.join(_roots(formed), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """The variant groups of the words of all texts."""
    return variant_groups(written(vocabulary(df, id_col, text), "vocabulary"), group)
