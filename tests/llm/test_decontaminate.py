import random

import pytest

from barlake.llm import decontaminate as d


def brute_tiles(text, item, shortest):
    """Greedy string tiling by trying every pair of starts."""
    free_a, free_b, tiles = [True] * len(text), [True] * len(item), []
    while True:
        best = None
        for i in range(len(text)):
            for j in range(len(item)):
                n = 0
                while i + n < len(text) and j + n < len(item) and free_a[i + n] and free_b[j + n] and text[i + n] == item[j + n]:
                    n += 1
                if n >= shortest and (best is None or n > best[0]):
                    best = (n, i, j)
        if best is None:
            return tiles
        n, i, j = best
        free_a[i:i + n] = free_b[j:j + n] = [False] * n
        tiles.append(best)


def test_tiling_matches_brute_force():
    rng = random.Random(6)
    for _ in range(120):
        text = [rng.randint(1, 3) for _ in range(rng.randint(0, 30))]
        item = [rng.randint(1, 3) for _ in range(rng.randint(0, 14))]
        assert d.tile(text, item, None, 2) == brute_tiles(text, item, 2)


ITEM = [f"fact{i}" for i in range(40)]


def tables(spark):
    rng = random.Random(1)
    noise = lambda n: " ".join(f"n{rng.randint(0, 5000)}" for _ in range(n))
    docs = [(1, noise(200) + " " + " ".join(ITEM) + " " + noise(90)),
            (2, " ".join(ITEM[30:] + ITEM[10:20]) + " " + noise(300) + " " + ", ".join(ITEM[:10]).upper()),
            (3, " ".join(ITEM[:12]) + " " + noise(50)), (4, noise(500)), (5, None), (6, ""), (1, " ".join(ITEM)),
            (7, " ".join(ITEM[i] for i in range(0, 40, 2)))]
    items = [(10, " ".join(ITEM)), (11, "too short"), (12, None), (13, noise(30)), (10, " ".join(ITEM[:30]))]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("slice_tokens", [500_000, 60])
def test_leaks_are_found_reordered_or_not(spark, slice_tokens):
    docs, items = tables(spark)
    got = d.leaked_pairs(docs, items, slice_tokens=slice_tokens).collect()
    found = sorted({(r["doc_id"], r["item_id"]) for r in got})
    assert found == [(1, 10), (2, 10)]
    assert all(r["coverage"] >= 0.5 for r in got)
    assert {r["tiles"] for r in got if r["doc_id"] == 1} == {1}
    assert sorted(r["doc_id"] for r in d.drop_leaked(docs, items).collect()) == [3, 4, 5, 6, 7]


def test_odd_and_empty_tables(spark, odd, none):
    _, items = tables(spark)
    assert d.leaked_pairs(odd, items).count() == 0
    kept = d.drop_leaked(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert d.leaked_pairs(none, items).count() == 0 and d.drop_leaked(odd, items.limit(0)).count() == odd.count()


def test_item_ids_of_any_type(spark):
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "lead " + text), (2, "clean words only here")], "doc_id long, text string")
    for kind, value in (("string", "item-a"), ("int", 7), ("long", 1 << 40)):
        bench = spark.createDataFrame([(value, text), (None, "another item with its own words " * 3)], f"item_id {kind}, text string")
        got = d.leaked_pairs(docs, bench).collect()
        assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, value)]
        assert d.drop_leaked(docs, bench).count() == 1
