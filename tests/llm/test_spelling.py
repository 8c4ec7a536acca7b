"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from barlake.llm import spelling as S


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(rows):
    counts = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute_groups(words):
    shapes = {}
    for w in words:  # words that agree but for one character, or one missing
        for i in range(len(w)):
            shapes.setdefault(w[:i] + "?" + w[i + 1:], set()).add(w)
            shapes.setdefault(w[:i] + w[i + 1:], set()).add(w)
        shapes.setdefault(w, set()).add(w)
    close = {w: set() for w in words}
    for group in shapes.values():
        for a in group:
            close[a] |= {b for b in group if b != a and near(a, b)}
    form = {}
    for w, n in words.items():
        best = min(close[w], key=lambda b: (-words[b], b), default=None)
        if best is not None and words[best] >= 10 * n:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(close[w]), words.get(form.get(w))))
    return out


def rows_of(df):
    rows = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def made_up(seed, n=400, letters="abé"):
    rng = random.Random(seed)
    words = {}
    for _ in range(n):
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(7, 10)))
        words[w] = rng.choice([2, 2, 3, 5, 20, 30, 200, 2500])
    return words


@pytest.mark.parametrize("group", [256, 3])
def test_groups_equal_brute_force(spark, group):
    words = made_up(group) | {"x" * 3000: 2, "x" * 2999: 40, "x" * 3001: 400, "aaaaaaa": 2, "aaaaaaaa": 20, "aaaaaaaaa": 300}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(S.variant_groups(df, group)) == brute_groups(words)


def test_scan_equals_brute_force():
    rng = random.Random(2)
    for letters in ("ab", "abcdef"):
        for _ in range(60):
            base = rng.randrange(1, 9)
            texts = sorted({"".join(rng.choice(letters) for _ in range(base + rng.randrange(2))) for _ in range(25)})
            want = {(a, b) for a, x in enumerate(texts) for b, y in enumerate(texts) if len(x) == base and x != y and near(x, y)}
            assert set(S.scan(texts, base)) == want


def test_odd_and_empty_tables(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert rows_of(S.spelling_variants(odd)) == brute_groups(brute_words(rows))
    assert S.spelling_variants(none).collect() == []


def test_query_on_the_given_table(spark):
    import duckdb

    from barlake.llm.queries import QUERIES

    path = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{path}/documents.parquet'").fetchall()
    assert rows_of(QUERIES["op13_spelling_variants"](spark, path)) == brute_groups(brute_words(rows))
