"""Mixing sources to target weights, in DataFrame expressions only.

Every source's documents are laid end to end and cut into blocks of
``block_words`` words.  Each output shard draws its source counts from a
multinomial over the targets; a source's slots are numbered through the shards,
and slot ``k`` takes block ``perm(k mod blocks)``, where ``perm`` is a
pseudorandom permutation of the source's block indices, one per epoch.  Slots and
blocks meet on (source, block).  That is the mix: each slot has its block's words, cut
from the documents; it is written, ``mix_blocks`` returns it, and ``mix_documents``
counts in it what it takes of each document.

The draws of all shards rarely hit a source's quota exactly; slots beyond a quota
pass, in order, to the sources that fell short, so each source gets its target
within half a block and no block is taken more than ``max_epochs`` times.

Null texts and texts without a word have size 0 and take part with ``taken`` 0.
A null source is a source of its own, ranked last.  Repeated rows are separate
documents.  Ties in the order of documents only occur between equal rows.  An
empty table gives an empty result.  Other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.llm.common import let, scratch, words_of, written

#: Words of a block and slots of an output shard.
BLOCK_WORDS = 128
SHARD_SLOTS = 4096
#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words; epochs that a source may be used.
SHARE = 1.5
MAX_EPOCHS = 2
#: Cells of the inverse distribution table that a draw looks up.
CELLS = 1 << 14
#: Rounds of the block permutation.
ROUNDS = 8
#: Rows of a bucket of the two-level running totals.
BUCKET_ROWS = 512
#: Source tables up to this many rows are broadcast; larger ones join by shuffle.
BROADCAST_SOURCES = 10_000


def bucket_totals(df: DataFrame, key: str, bucket: str, value: str, total: str, out: str, levels: int = 2) -> DataFrame:
    """(key, bucket, total, out): the sum of ``value`` in each bucket and in the earlier
    buckets of its key, totalled ``levels`` deep so that no window holds a key."""
    sums = df.groupBy(key, bucket).agg(F.sum(value).alias(total))
    if levels:
        up = f"_up{levels}"
        return running_total(sums.withColumn(up, F.expr(f"{bucket} div 1024")), key, up, [bucket], total, out, levels - 1).drop(up)
    whole = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn(out, F.coalesce(F.sum(total).over(whole), F.lit(0)))


def running_total(df: DataFrame, key: str, bucket: str, order: Sequence[str], value: str, out: str,
                  levels: int = 2) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the earlier rows of ``key``, in the
    order (``bucket``, ``order``).  No window is wider than a bucket: bucket sums
    are totalled the same way and joined back."""
    total, before, own = (f"_{name}{levels}" for name in ("total", "before", "own"))
    inner = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = bucket_totals(df, key, bucket, value, total, before, levels)
    rows = df.withColumn(own, F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return rows.join(sums.select(key, bucket, before), [key, bucket]).withColumn(
        out, F.col(own) + F.col(before)).drop(own, before)


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
                   max_epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: sid, source, source_size, target, blocks, quota.

    Targets follow the weights up to ``max_epochs`` times the source's size; what
    a full source can't take is shared out again.  With the sources sorted by cap
    per weight this has a closed form: the first source whose cap lies above the
    level that is left over for it and its followers sets the level of them all."""
    ranked = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")) \
        .withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.col("sid") - 1) % len(weights))) \
        .withColumn("cap", F.col("source_size") * F.lit(max_epochs).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) \
        / F.sum("weight").over(rest)
    ranked = ranked.withColumn("own_level", level)
    # a level below the cap of its source is final; the first such level is the highest
    open_level = F.when(F.col("cap") / F.col("weight") > F.col("own_level"), F.col("own_level"))
    ranked = ranked.withColumn("level", F.max(open_level).over(every))
    target = F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap"))
    blocks = F.ceil(F.col("source_size") / block_words)
    return ranked.withColumn("target", target).withColumn("blocks", blocks).withColumn(
        "quota", F.when(F.col("source_size") > 0, F.least(
            F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"),
            F.col("blocks") * max_epochs)).otherwise(0)) \
        .select(F.col("sid").cast("long"), "source", "docs", "source_size", "target", "blocks", "quota")


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """Swap-or-not permutation of [0, n): each round mirrors the index at a keyed
    point or leaves it, by a keyed bit that both partners share."""

    def step(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(*key, r), n) + n - x, n)
        bit = F.xxhash64(F.greatest(x, mirror), *key, r, F.lit(1)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, mirror).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), index, step)


def drawn_counts(sources: DataFrame, seed: int, shard_slots: int, cells: int) -> DataFrame:
    """(sid, shard, n): multinomial source counts of each shard.  A draw hashes its
    slot number to one of ``cells`` cells, which the sources own in proportion to
    their targets; the cell table has a fixed number of rows and is broadcast."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("quota")).first()[0] or 0
    order = Window.orderBy("sid")
    upto = F.sum("quota").over(order.rowsBetween(Window.unboundedPreceding, 0))
    bounds = sources.filter("quota > 0").withColumn("hi", F.round(upto * cells / F.sum("quota").over(Window.partitionBy())).cast("long")) \
        .withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0))).filter("hi > lo")
    table = bounds.select("sid", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("cell"))
    slots = spark.range(0, total, 1, max(spark.sparkContext.defaultParallelism, total // (1 << 22) + 1)) if total \
        else spark.range(0)
    drawn = slots.select(F.expr(f"id div {shard_slots}").alias("shard"),
                         F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(cells)).alias("cell"))
    return drawn.join(F.broadcast(table), "cell").groupBy("sid", "shard").agg(F.count("*").alias("n"))


def mix_slots(sources: DataFrame, seed: int = 8, shard_slots: int = SHARD_SLOTS, cells: int = CELLS) -> DataFrame:
    """(shard, sid, epoch, block): the plan of the mix, one row per output slot."""
    counts = written(drawn_counts(sources, seed, shard_slots, cells), "draws")
    totals = sources.select("sid", "quota", "blocks").join(
        counts.groupBy("sid").agg(F.sum("n").alias("drawn")), "sid", "left").fillna(0, ["drawn"])
    by_sid = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    over, short = F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)), F.greatest(F.col("quota") - F.col("drawn"), F.lit(0))
    totals = written(totals.withColumn("over", over).withColumn("short", short)
                     .withColumn("over_from", F.coalesce(F.sum("over").over(by_sid), F.lit(0)))
                     .withColumn("short_from", F.coalesce(F.sum("short").over(by_sid), F.lit(0))), "totals")
    numbered = running_total(counts.withColumn("part", F.expr("shard div 1024")), "sid", "part", ["shard"], "n", "first")
    placed = numbered.select("sid", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("k")) \
        .join(totals.hint("broadcast") if totals.count() <= BROADCAST_SOURCES else totals, "sid")
    kept = placed.filter("k < quota").select("shard", "sid", "k", "blocks")
    excess = placed.filter("k >= quota").select("shard", (F.col("over_from") + F.col("k") - F.col("quota")).alias("e"))
    # wanted has a row per slot: never broadcast, though the planner takes it for as small as totals
    wanted = totals.filter("short > 0").select(
        "sid", "blocks", "drawn", "short_from",
        F.explode(F.sequence(F.col("short_from"), F.col("short_from") + F.col("short") - 1)).alias("e"))
    moved = excess.join(wanted.hint("merge"), "e").select(
        "shard", "sid", (F.col("drawn") + F.col("e") - F.col("short_from")).alias("k"), "blocks")
    slots = kept.unionByName(moved).withColumn("epoch", F.expr("k div blocks"))
    return slots.select("shard", "sid", "epoch", permuted(
        F.pmod(F.col("k"), F.col("blocks")), F.col("blocks"), F.col("sid"), F.col("epoch"), F.lit(seed)).alias("block"))


def bucketed(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with the sid of their source and their bucket in it."""
    small = sources.select("sid", "source", "docs")
    small = F.broadcast(small) if sources.count() <= BROADCAST_SOURCES else small
    return sized.join(small, sized["source"].eqNullSafe(small["source"])).drop("source").withColumn(
        "bucket", F.pmod(F.xxhash64("_id", "size"), F.ceil(F.col("docs") / BUCKET_ROWS))).drop("docs")


def numbered(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """(sid, _id, size, first): documents with the number of their first word in their
    source, in the order of bucket, id and size."""
    return running_total(bucketed(sized, sources), "sid", "bucket", ["_id", "size"], "size", "first") \
        .filter("size > 0").select("sid", "_id", "size", "first")


def _pieces(block_words: int) -> Column:
    """array<struct<block, n, words>>: the pieces of a document's words by block."""

    def cut(words: Column) -> Column:
        def piece(block: Column) -> Column:
            lo = F.greatest(F.col("first"), block * block_words) - F.col("first")
            hi = F.least(F.col("size"), (block + 1) * block_words - F.col("first"))
            return F.struct(block.alias("block"), (hi - lo).cast("int").alias("n"),
                            F.array_join(F.slice(words, (lo + 1).cast("int"), (hi - lo).cast("int")), " ").alias("words"))

        return F.transform(F.sequence(F.expr(f"first div {block_words}"), F.expr(f"(first + size - 1) div {block_words}")), piece)

    return let(words_of(F.col("_text")), cut)


def _joined(rows: DataFrame, sized: DataFrame, sources: DataFrame, slots: DataFrame, block_words: int) -> DataFrame:
    """The mix: slots with the pieces of their blocks.

    Slots travel to the bucket of documents where their block begins, so that texts are
    shuffled once, by (source, bucket), and numbered, cut and joined there.  Only blocks
    at the edge of a bucket, whose words may lie in two, are brought together by a
    second, small shuffle of their pieces."""
    starts = written(bucket_totals(bucketed(sized, sources), "sid", "bucket", "size", "words", "before"), "starts")
    begin, end = F.ceil(F.col("before") / block_words), F.ceil((F.col("before") + F.col("words")) / block_words)
    # homes has a row per block: dealt out before it grows, and never broadcast, though the planner takes it for as small as starts
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, (sources.agg(F.sum("blocks")).first()[0] or 0) // (1 << 20) + 1)
    homes = starts.filter(begin < end).repartition(parts, "sid", "bucket") \
        .select("sid", "bucket", F.explode(F.sequence(begin, end - 1)).alias("block"))
    placed = slots.join(homes.hint("merge"), ["sid", "block"]).select(
        "sid", "bucket", F.lit(2).alias("kind"), "block", F.struct("shard", "slot", "epoch").alias("slot"))
    heads = starts.select("sid", "bucket", F.lit(0).alias("kind"), F.col("before").alias("size"), "before",
                          (F.col("before") + F.col("words")).alias("stop"))
    texts = bucketed(rows, sources).filter("size > 0").withColumn("kind", F.lit(1))
    every = texts.unionByName(heads, allowMissingColumns=True).unionByName(placed, allowMissingColumns=True)
    # a bucket's head comes first and adds the words before it
    earlier = Window.partitionBy("sid", "bucket").orderBy("kind", "_id", "size", "_text").rowsBetween(Window.unboundedPreceding, -1)
    every = every.select("sid", "bucket", "kind", "_id", "size", "_text", "block", "slot", F.sum("size").over(earlier).alias("first"),
                         F.first("before").over(earlier).alias("before"), F.first("stop").over(earlier).alias("stop")).filter("kind > 0")
    at_edge = (F.col("block") * block_words < F.col("before")) | ((F.col("block") + 1) * block_words > F.col("stop"))
    near_edge = (F.col("kind") == 2) | (F.col("first") < F.ceil(F.col("before") / block_words) * block_words) \
        | (F.col("first") + F.col("size") > F.floor(F.col("stop") / block_words) * block_words)

    def flat(rows: DataFrame) -> DataFrame:
        none = F.array(F.struct(F.col("block"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("string").alias("words")))
        cut = rows.withColumn("piece", F.explode(F.when(F.col("kind") == 1, _pieces(block_words)).otherwise(none)))
        part = F.when(F.col("kind") == 1, F.struct("first", F.col("piece.n").alias("n"), F.col("piece.words").alias("words")))
        return cut.select("sid", "bucket", F.col("piece.block").alias("block"), part.alias("part"), "slot", "before", "stop")

    def blocks(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.array_sort(F.collect_list("part")).alias("parts"), F.collect_list("slot").alias("slots")) \
            .select("sid", "block", "parts", "slots")

    whole = blocks(flat(every).filter(~at_edge), "sid", "bucket", "block")
    edges = blocks(flat(every.filter(near_edge)).filter(at_edge), "sid", "block")
    return whole.unionByName(edges).select("sid", "block", "parts", F.explode("slots").alias("slot")).select(
        "slot.shard", "slot.slot", "sid", "slot.epoch", "block", F.col("parts.first").alias("firsts"),
        F.col("parts.n").alias("counts"), F.array_join("parts.words", " ").alias("words"))


def _mix(df: DataFrame, id_col: str, text: str, source: str, block_words: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Document sizes, sources and the written mix: (shard, slot, sid, epoch, block, the
    first word and the word count of each of its documents, words)."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("_id"), F.col(source).alias("source"), F.col(text).alias("_text")) \
        .withColumn("size", F.size(words_of(F.col("_text"))).cast("long"))
    sized = written(rows.drop("_text"), "sizes")
    sources = written(source_targets(sized, block_words=block_words), "sources")
    # a shard has a bounded number of slots
    order = Window.partitionBy("shard").orderBy(F.xxhash64("sid", "epoch", "block", F.lit(seed)), "sid", "epoch", "block")
    slots = mix_slots(sources, seed).withColumn("slot", F.row_number().over(order) - 1)
    path = scratch(spark, "mix")
    _joined(rows, sized, sources, slots, block_words).write.option("compression", "zstd").parquet(path)
    return sized, sources, spark.read.parquet(path)


def mix_blocks(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
               block_words: int = BLOCK_WORDS, seed: int = 8) -> DataFrame:
    """The mix itself, a row per output slot: shard, slot, source, epoch, block, tokens."""
    _, sources, mix = _mix(df, id_col, text, source, block_words, seed)
    small = sources.select("sid", "source")
    small = F.broadcast(small) if sources.count() <= BROADCAST_SOURCES else small
    return mix.join(small, "sid").select("shard", "slot", "source", "epoch", "block", F.split("words", " ").alias("tokens"))


def mix_documents(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
                  block_words: int = BLOCK_WORDS, seed: int = 8) -> DataFrame:
    """Per document: id, size, source_size, target, taken (words in the mix, repeats counted)."""
    sized, sources, mix = _mix(df, id_col, text, source, block_words, seed)
    used = mix.select("sid", F.explode(F.arrays_zip("firsts", "counts")).alias("part")) \
        .groupBy("sid", F.col("part.firsts").alias("first")).agg(F.sum("part.counts").alias("used"))
    taken = numbered(sized, sources).join(used, ["sid", "first"], "left") \
        .select("sid", "_id", "size", F.coalesce("used", F.lit(0)).cast("long").alias("taken"))
    wordless = sized.filter("size = 0").select("source", "_id", "size", F.lit(0).cast("long").alias("taken"))
    small = sources.select("sid", "source", "source_size", "target")
    small = F.broadcast(small) if sources.count() <= BROADCAST_SOURCES else small
    out = [F.col("_id").alias(id_col), "size", "source_size", "target", "taken"]
    full = taken.join(small, "sid").select(*out)
    empty = wordless.join(small, wordless["source"].eqNullSafe(small["source"])).select(*out)
    return full.unionByName(empty)
