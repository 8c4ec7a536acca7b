import re
from collections import Counter, defaultdict
from itertools import takewhile

from pyspark.sql import functions as F

from barlake.llm import mixing as m


def water_fill(sizes, weights=(3, 1, 2), share=1.5):
    """Targets by repeated resharing, from the contract's words."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full, target = share * sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        target = {s: 2 * sizes[s] for s in full} | {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def corpus(spark):
    rows = []
    for i in range(900):
        source = [None, "a", "b", "B", "é", "hot"][min(5, i % 9)]
        rows.append((i % 880, "w " * (i * 37 % 211), source))
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_and_takes(spark):
    df = corpus(spark)
    sizes = Counter()
    for r in df.collect():
        sizes[r["source"]] += len(r["text"].split())
    want = water_fill(sizes)
    got = m.mix_documents(df).collect()
    assert len(got) == df.count()
    by_size = {sizes[s]: want[s] for s in sizes}
    taken = defaultdict(int)
    for r in got:
        assert abs(r["target"] - by_size[r["source_size"]]) < 1e-6 * max(1, r["target"])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source_size"]] += r["taken"]
    for size, target in by_size.items():
        assert abs(taken[size] - target) <= max(m.BLOCK_WORDS, 0.03 * target)


def test_reruns_agree(spark):
    df = corpus(spark)
    a = Counter(map(tuple, m.mix_documents(df).collect()))
    b = Counter(map(tuple, m.mix_documents(df.repartition(13)).collect()))
    assert a == b


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 7, 100, 257):
        got = spark.range(n).select(m.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p")).collect()
        assert sorted(r["p"] for r in got) == list(range(n))


def test_every_source_gets_its_quota_of_distinct_slots(spark):
    sources = spark.createDataFrame([(1, "a", 10, 50_000, 70_000.0, 391, 547), (2, "b", 3, 900, 1_800.0, 8, 16)],
                                    "sid long, source string, docs long, source_size long, target double, blocks long, quota long")
    slots = m.mix_slots(sources, shard_slots=64).collect()
    assert Counter(r["sid"] for r in slots) == {1: 547, 2: 16}
    assert max(Counter((r["sid"], r["epoch"], r["block"]) for r in slots).values()) == 1
    assert max(Counter((r["sid"], r["block"]) for r in slots).values()) == 2


def test_running_total(spark):
    df = spark.createDataFrame([(k, i // 3, i, i * 7 % 5) for k in "xy" for i in range(50)], "k string, b long, o long, v long")
    for r in m.running_total(df, "k", "b", ["o"], "v", "s").collect():
        assert r["s"] == sum(i * 7 % 5 for i in range(r["o"]))


def test_odd_and_empty_tables(odd, none):
    assert m.mix_documents(odd).count() == odd.count()
    assert m.mix_documents(none).count() == 0
    wordless = odd.filter("doc_id in (1, 2, 3)")
    assert [r["taken"] for r in m.mix_documents(wordless).collect()] == [0, 0, 0]


def test_the_mix_holds_the_words_that_are_counted(spark):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(i * 37 % 411)), [None, "a", "b"][i % 3]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = m.mix_blocks(df).collect()
    assert len({(r["shard"], r["slot"]) for r in mix}) == len(mix)
    words, where = Counter(), {}
    for r in mix:
        assert 0 < len(r["tokens"]) <= m.BLOCK_WORDS
        assert where.setdefault((r["source"], r["block"]), r["tokens"]) == r["tokens"]
        words.update(r["tokens"])
        for a, b in zip(r["tokens"], r["tokens"][1:]):
            (d, k), (e, n) = a[1:].split("w"), b[1:].split("w")
            assert int(n) == (int(k) + 1 if d == e else 0)
        assert all(rows[int(t[1:].split("w")[0])][2] == r["source"] for t in r["tokens"])
    taken = Counter()
    for word, n in words.items():
        taken[int(word[1:].split("w")[0])] += n
    assert {r["doc_id"]: r["taken"] for r in m.mix_documents(df).collect() if r["taken"]} == taken


def test_nothing_with_a_row_per_block_or_slot_is_broadcast(spark):
    rows = corpus(spark).selectExpr("doc_id AS _id", "source", "text AS _text", "CAST(length(text) DIV 2 AS LONG) AS size")
    sized = rows.drop("_text")
    sources = m.written(m.source_targets(sized), "sources")
    slots = m.mix_slots(sources).withColumn("slot", F.lit(0))
    lines = m._joined(rows, sized, sources, slots, m.BLOCK_WORDS)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [re.search("[A-Z]", line).start() if re.search("[A-Z]", line) else 0 for line in lines]
    assert sum("Generate explode(sequence" in line for line in lines) >= 3
    for i in (i for i, line in enumerate(lines) if "BroadcastExchange" in line):
        below = takewhile(lambda k: depth[k] > depth[i], range(i + 1, len(lines)))
        assert not any("Generate explode(sequence" in lines[k] for k in below)
