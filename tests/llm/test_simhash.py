import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from barlake.llm import simhash as s
from barlake.llm.components import components


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(items, linked):
    parent = {i: i for i in items}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in linked:
        parent[root(a)] = root(b)
    out = defaultdict(set)
    for i in items:
        out[root(i)].add(i)
    return {frozenset(g) for g in out.values()}


def near(n=120, seed=1):
    rng = np.random.default_rng(seed)
    out = set()
    for base in rng.integers(0, 2 ** 63, n, dtype=np.uint64):
        for _ in range(rng.integers(1, 12)):
            x = int(base)
            for bit in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(bit)
            out.add(x)
    return np.array(sorted(out), np.uint64)


def linked_pairs(fps, radius=4):
    return [(int(a), int(b)) for i, a in enumerate(fps) for b in fps[:i] if bin(int(a ^ b)).count("1") <= radius]


@pytest.mark.parametrize("radius", [0, 3, 4, 7])
def test_bit_sliced_distances(radius):
    fps = near()
    planes = s.Planes(fps)
    for i in range(0, len(fps), 13):
        want = [j for j in range(i, len(fps)) if bin(int(fps[i] ^ fps[j])).count("1") <= radius]
        assert planes.within(int(fps[i]), radius, i).tolist() == want


def test_forest_spans_all_links():
    fps = near()
    want = groups(fps.tolist(), linked_pairs(fps))
    assert groups(fps.tolist(), s.forest(fps, None)) == want
    assert len(s.forest(fps, None)) == len(fps) - len(want)


@pytest.mark.parametrize("tile,few,blocks", [(1024, 48, 6), (5, 48, 6), (1024, 2, 5), (3, 2, 7)])
def test_no_link_is_lost_on_spark(spark, monkeypatch, tile, few, blocks):
    monkeypatch.setattr(s, "FEW", few)
    fps = near(60)
    rows = spark.createDataFrame([(x, i) for i, x in enumerate(fps.view(np.int64).tolist())], "fp long, doc_id long")
    got = s.links(s.classes_of(rows, "doc_id"), blocks=blocks, tile=tile).collect()
    assert groups(fps.tolist(), [(r["a"] % 2 ** 64, r["b"] % 2 ** 64) for r in got]) == groups(fps.tolist(), linked_pairs(fps))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    nodes = spark.createDataFrame([(i, i) for i in [*range(41), *range(100, 160), 500]], "node long, rank long")
    got = {r["node"]: r["label"] for r in components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160))


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 200))) for _ in range(40)]
    texts += [t.replace(" w1 ", " w2 ", 1).upper() for t in texts[:15]] + texts[:10] + ["a b", "a b", "A  B", "", None, " \n"]
    return texts


def test_matches_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in s.near_duplicates(df.repartition(5)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    ids = range(len(texts))
    pairs = [(a, b) for a in ids for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 4]
    for g in groups(ids, pairs):
        for i in g:
            assert got[i]["fingerprint"] == format(fps[i], "016x") and got[i]["component_id"] == min(g)
    kept = sorted(r["doc_id"] for r in s.keep_first(df).collect())
    assert kept == sorted(min(g) for g in groups(ids, pairs))


def test_odd_and_empty_tables(odd, none):
    got = s.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == 1
    assert by[7]["component_id"] == 6 and by[None]["component_id"] is None
    kept = s.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == len({r["fingerprint"] for r in got})
    assert s.near_duplicates(none).count() == 0 and s.keep_first(none).count() == 0


def test_an_id_with_two_texts_keeps_one_of_each_group(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (1, "one two three four five six seven")], "doc_id long, text string")
    assert s.keep_first(df).count() == 2
