import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from barlake.llm import anchors
from barlake.llm import suffix_dedup as d
from barlake.llm.column_bwt import repeated_starts

L = 40


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    make = lambda k: "".join(rng.choice("abcdefgh é") for _ in range(k))
    shared = [make(k) for k in (39, 40, 41, 60, 150, 300)]
    texts = []
    for i in range(n):
        parts = [make(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(shared), make(rng.randint(0, 60))]
        texts.append("".join(parts))
    near = [t[:len(t) // 2] + "#" + t[len(t) // 2 + 1:] for t in texts[:12]]
    return texts + near + texts[:5] + ["ab" * 60, "a" * 41, "b" * 40, "c" * 39, "", None, make(50) * 3]


@pytest.mark.parametrize("bounds", [{}, {"collection_bytes": 300}, {"max_pieces": 1}, {"max_pieces": 3, "collection_bytes": 1000}])
def test_matches_brute_force(spark, bounds):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: tuple(r)[1:] for r in d.dedup_digests(df, length=L, **bounds).collect()}
    assert got == dict(enumerate(brute(texts, L)))


def test_production_length(spark):
    rng = random.Random(9)
    make = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage, long = make(260), make(70_000)
    texts = [make(100) + passage + make(90), passage[:199] + make(10), passage + make(5), long, make(3) + long[500:60_000] + make(9)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in d.dedup_digests(df).collect()}
    assert got == dict(enumerate(brute(texts, 200)))
    assert got[0][1] == 260 and got[1][1] == 0 and got[2][1] == 260 and got[3][1] >= 59_500


def test_texts_lose_what_repeats(spark):
    df = spark.createDataFrame([(1, "x" + "q" * 250, "a"), (2, "été" + "q" * 250 + "z", "b"), (3, None, None)],
                               "doc_id long, text string, text2 string")
    got = {r["doc_id"]: r["text"] for r in d.dedup_texts(df).collect()}
    assert got == {1: "x", 2: "étéz", 3: ""}


def test_every_string_has_one_anchor_that_moves_with_it():
    rng = random.Random(2)
    core = bytes(rng.choice(b"abc") for _ in range(400))
    a, b = core, b"zz" * 50 + core + b"yy" * 30

    def by_start(text):
        out = {}
        for h, p, lo, hi in zip(*(x.tolist() for x in anchors.find(text, 200))):
            for start in range(lo, hi + 1):
                assert start not in out
                out[start] = (h, p - start)
        return out
    one, two = by_start(a), by_start(b)
    assert sorted(one) == list(range(201)) and sorted(two) == list(range(len(b) - 199))
    assert all(two[i + 100] == one[i] for i in one)


def test_columns_match_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        n = rng.choice([3, 5, 9])
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(n, n + 8))) for _ in range(rng.randint(1, 40))]
        at, copies = [rng.randint(0, 4) for _ in strings], [rng.choice([1, 1, 2]) for _ in strings]
        count = Counter()
        for s, a, c in zip(strings, at, copies):
            for i in range(len(s) - n + 1):
                count[s[i:i + n], a - i] += c
        for s, a, mask in zip(strings, at, repeated_starts(strings, at, copies, n)):
            assert np.array_equal(mask, [count[s[i:i + n], a - i] > 1 for i in range(len(s) - n + 1)])


def test_odd_and_empty_tables(odd, none):
    got = d.dedup_digests(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[6]["n_removed"] == by[6]["n_bytes"] and by[1]["n_bytes"] == 0 and by[4]["n_removed"] == 0
    texts = d.dedup_texts(odd)
    assert texts.columns == odd.columns and texts.count() == odd.count()
    assert d.dedup_digests(none).count() == 0 and d.dedup_texts(none).count() == 0
