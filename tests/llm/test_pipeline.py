import os
import re
from collections import Counter, defaultdict

import corpus_pipeline
from barlake.llm import decontaminate as tiling
from tests.llm.test_quality import brute as quality
from tests.llm.test_simhash import brute_fingerprint, groups
from tests.conftest import SF001

JUNK = (lambda t, n: sum(c in "#*$%&|<>" for c in t) * 10 > n,
        lambda t, n: t.count("!!") * 10 > n)


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "suffix_dedup", "decontaminate", "mix_sources"]


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(os.path.join(SF001, "documents.parquet"))
    seen = {0: docs}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        seen[k + 1] = spark.createDataFrame(stage(spark, seen[k], SF001).collect()).cache() if k < 4 else stage(spark, seen[k], SF001)
        if k < 4:
            assert seen[k + 1].columns == corpus_pipeline.COLUMNS
    rows = [{r["doc_id"]: r["text"] for r in seen[k].collect()} for k in range(5)]
    # quality: what the base rejects goes, what no junk rule could reject stays
    for i, t in rows[0].items():
        n, *_, failed = quality(t)
        if failed:
            assert i not in rows[1]
        elif not any(rule(t, n) for rule in JUNK) and sum(c.isupper() for c in t) * 4 < len(t):
            assert i in rows[1] or _stutters(t)
    # one document of each group
    fp = {i: brute_fingerprint(t) for i, t in rows[1].items()}
    pairs = [(a, b) for a in fp for b in fp if a < b and bin(fp[a] ^ fp[b]).count("1") <= 4]
    assert set(rows[2]) == {min(g) for g in groups(list(fp), pairs)}
    # repeated 200-byte strings
    raw = {i: t.encode() for i, t in rows[2].items()}
    count = Counter(b[k:k + 200] for b in raw.values() for k in range(len(b) - 199))
    for i, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if count[b[k:k + 200]] > 1:
                gone[k:k + 200] = b"\1" * 200
        assert rows[3][i] == bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    # benchmark items: every item is tiled against every document
    items = [tiling.tokens(r["text"]) for r in spark.read.parquet(os.path.join(SF001, "benchmark.parquet")).collect()]
    number: dict[str, int] = defaultdict(lambda: len(number) + 1)
    items = [[number[w] for w in ws] for ws in items]
    for i, t in rows[3].items():
        ids = [number[w] for w in tiling.tokens(t)]
        grams = {tuple(ids[k:k + 5]) for k in range(len(ids) - 4)}
        near = [ws for ws in items if any(tuple(ws[k:k + 5]) in grams for k in range(len(ws) - 4))]
        leaked = any(sum(n for n, _, _ in tiling.tile(ids, ws)) >= 0.5 * len(ws) for ws in near)
        assert leaked == (i not in rows[4])
    # the mix
    mixed = seen[5].collect()
    assert {r["doc_id"]: r["size"] for r in mixed} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in rows[4].items()}
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in mixed)
    total = sum(r["size"] for r in mixed)
    assert abs(sum(r["taken"] for r in mixed) - 1.5 * total) < 0.02 * total


def _stutters(text):
    words = text.split()
    return sum(a == b for a, b in zip(words, words[1:])) * 10 > 3 * len(words) or len(set(text.split("\n"))) * 2 < len(text.split("\n"))


def test_run_equals_its_stages(spark):
    got = corpus_pipeline.run(spark, SF001)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"] and got.count() > 0


def test_entry_without_the_corpus_package(tmp_path):
    """The entry file imports, and the other queries stay, where the package is absent."""
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    shutil.copytree(os.path.join(root, "barlake"), tmp_path / "barlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') and k[2].isdigit() for k in e.queries()))"],
                         cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, found = out.stdout.split()[-2:]
    assert int(n) > 100 and found == "False"
