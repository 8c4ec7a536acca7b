import itertools
import zlib

import numpy as np

from barlake.llm import toxicity as t

PLAIN = "a river ran down from hills over stones toward sea birds flew low boats waited men sang old songs rain fell".split()
BAD = ["grumfo", "grumfoes", "grumfing", "zlork", "zlorky"]


def corpus(spark, n=900):
    docs, labels = [], []
    for i in range(n):
        words = [PLAIN[(i * 7 + k * (3 + i % 5)) % len(PLAIN)] for k in range(20)]
        toxic = i % 6 == 0
        if toxic:
            words[3 + i % 9] = BAD[i // 6 % 5]
            words[14] = BAD[i // 30 % 5]
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_held_out_documents_are_scored_right(spark):
    docs, labels = corpus(spark)
    got = t.score_documents(docs, labels).collect()
    assert len(got) == 900
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["doc_id"] % 6 == 0) and 0 <= r["score"] <= 1
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        if r["predicted"]:
            assert {text[r["doc_id"]][s["start"]:s["stop"]] for s in r["spans"]} <= set(BAD) and r["spans"]


def test_marginals_match_enumeration():
    rng = np.random.default_rng(5)
    moves = rng.normal(size=(2, 2))
    lengths = np.array([6, 4, 1])
    emission = rng.normal(size=(3, 6))
    got = t.marginals(emission, lengths, moves)
    for row, n in enumerate(lengths):
        weight = np.zeros((n, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            score = sum(emission[row, i] * s for i, s in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))
            for i, s in enumerate(path):
                weight[i, s] += np.exp(score)
        assert np.allclose(got[row, :n], weight[:, 1] / weight.sum(axis=1))


def test_labels_of_held_out_rows_are_never_read(spark):
    from pyspark.sql import functions as F
    docs, labels = corpus(spark, 300)
    flipped = labels.withColumn("toxic", F.when(t.held_out(F.col("doc_id"), 5, 0), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    pick = lambda d: sorted((r["doc_id"], round(r["score"], 9)) for r in d.collect())
    assert pick(t.score_documents(docs, labels)) == pick(t.score_documents(docs, flipped))


def test_sequences_cover_every_word():
    assert t.sequences(["w"] * 300, [0, 260, 40]) == [(0, 128), (128, 256), (256, 260), (260, 300)]


def test_odd_and_empty_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 1), (4, 1, 0), (None, 1, 1), (6, None, None), (6, 1, 1)], "doc_id long, quality int, toxic int")
    assert t.score_documents(odd, labels).count() == odd.count()
    assert t.score_documents(none, labels).count() == 0
    assert t.score_documents(odd, labels.limit(0)).filter("score = 0").count() == odd.count()
    docs, marks = corpus(spark, 300)
    scored = t.score_documents(docs.unionByName(odd.select(*docs.columns)), marks)
    assert scored.filter("trim(doc_id) in ('1')").count() == 2 and scored.filter("score is null").count() == 0


def test_a_pair_of_ordinary_words(spark):
    """Toxic is "dark" followed by "river"; both are as common elsewhere."""
    rng = np.random.default_rng(9)
    docs, labels = [], []
    for i in range(2000):
        words = [PLAIN[j] for j in rng.integers(len(PLAIN), size=24)] + ["dark", "river"] * 2
        rng.shuffle(words)
        words = [w for k, w in enumerate(words) if not (w == "river" and k and words[k - 1] == "dark")]
        if i % 5 == 1:
            at = int(rng.integers(2, len(words) - 2))
            words[at:at] = ["dark", "river"]
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 1)))
    got = t.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in got if r["held_out"]]
    right = sum(r["predicted"] == int(r["doc_id"] % 5 == 1) for r in held)
    assert right >= 0.97 * len(held)
    text = dict(docs)
    assert all(any(text[r["doc_id"]][s["start"]:s["stop"]] == "dark river" for s in r["spans"]) for r in held if r["predicted"])


def test_scores_equal_brute_force(spark):
    """Document scores from marginals by enumeration over all taggings."""
    docs, labels = corpus(spark, 600)
    f = t.learn(docs, labels)
    few = docs.limit(6).collect()
    got = {r["doc_id"]: r["score"] for r in t.score_documents(docs, labels).collect()}
    for row in few:
        words = row["text"].split()[:20]
        emission = [f.bias + sum(f.weights[zlib.crc32(n.encode()) % t.FEATURES] for n in t.feature_names(w)) for w in words]
        weight = np.zeros((len(words), 2))
        # exact sums over the 2^20 taggings by elimination, one word fixed at a time
        for at in range(len(words)):
            for state in (0, 1):
                vec = None
                for k, e in enumerate(emission):
                    own = np.array([1.0, np.exp(e)])
                    if k == at:
                        own[1 - state] = 0.0
                    vec = own if vec is None else own * (vec @ np.exp(f.moves))
                weight[at, state] = vec.sum()
        p = weight[:, 1] / weight.sum(axis=1)
        top = min(12.0, max(-12.0, float(np.log((p.max() + 1e-12) / (1 - p.max() + 1e-12)))))
        a, b, c = f.score
        odds = a + b * top + c * np.log1p(p[p > 0.05].sum())
        assert abs(1 / (1 + np.exp(-odds)) - got[row["doc_id"]]) < 1e-6
