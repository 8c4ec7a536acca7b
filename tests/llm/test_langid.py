import zlib

from barlake.llm import langid as g

EN = "the cat and the dog went over the hill to see the old house by the river".split()
DE = "der hund und die katze gingen über den hügel um das alte haus am fluss zu sehen".split()


def corpus(spark, n=400):
    rows = []
    for i in range(n):
        words, lang = (EN, "en") if i % 3 else (DE, "de")
        rows.append((i, " ".join(words[(i * 7 + k * 5) % len(words)] for k in range(12)), lang, "s", 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_held_out_accuracy_and_flag(spark):
    got = g.identify(corpus(spark)).collect()
    assert len(got) == 400
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["lang_pred"] == ("en" if r["doc_id"] % 3 else "de") and 0 <= r["score"] <= 1


def test_word_scores_come_first_then_shorter_grams():
    import math
    words = [("en", "the", 8, 10), ("en", "xyz", 2, 10), ("de", "the", 1, 10), ("de", "der", 9, 10)]
    grams = [("en", "th", 5, 20), ("de", "de", 5, 20), ("en", "q", 10, 20)]
    m = g.Model(words, grams)
    assert m.languages == ["de", "en"]
    assert m.score("the") == [math.log(.1), math.log(.8)]
    low = -math.log(40)
    # an unknown word: "th" as one gram, "q" as a shorter one, "w" at the floor of both
    got = m.score("thqw")
    want = [low + low + m.floor, math.log(.25) + math.log(.5) + m.floor]
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, want))


def test_counts_match_brute_force(spark):
    from collections import Counter
    df = corpus(spark, 60)
    want = Counter((r["lang"], w) for r in df.collect() for w in r["text"].split())
    words = g.word_counts(df, "lang", "text")
    assert {(r["lang"], r["word"]): r["n"] for r in words.collect()} == want
    grams = Counter()
    for (lang, w), n in want.items():
        for size in range(1, g.MAX_GRAM + 1):
            for at in range(len(w) - size + 1):
                grams[lang, w[at:at + size]] += n
    assert {(r["lang"], r["gram"]): r["n"] for r in g.gram_counts(words).collect()} == grams
    assert {(a, b, n) for a, b, n, _ in g._top(words, "word", 1000)} == {(a, b, n) for (a, b), n in want.items()}
    kept = g._top(words, "word", 3)
    assert kept and all(sum(1 for k in kept if k[0] == lang) <= 3 for lang in ("en", "de"))


def test_labels_of_held_out_rows_are_never_read(spark):
    from pyspark.sql import functions as F
    df = corpus(spark)
    other = df.withColumn("lang", F.when(g.held_out(F.col("doc_id"), 4, 2), "zz").otherwise(F.col("lang")))
    assert sorted(map(tuple, g.identify(df).collect())) == sorted(map(tuple, g.identify(other).collect()))


def test_odd_and_empty_tables(odd, none):
    got = g.identify(odd).collect()
    assert len(got) == odd.count()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert g.identify(none).count() == 0
    unlabelled = odd.filter("lang is null")
    assert {r["lang_pred"] for r in g.identify(unlabelled).collect()} == {"und"}


def test_a_rare_language_takes_no_texts_of_a_large_one(spark):
    rows = [tuple(r) for r in corpus(spark, 800).collect()]
    many = [(1000 + i, " ".join(f"{w}{chr(97 + i % 26)}{chr(97 + i // 26)}" for w in EN), "en", "s", 1) for i in range(200)]
    rare = next(i for i in range(5000, 5100) if zlib.crc32(str(i).encode()) % 4 != 2)
    tiny = [(rare, "zoq zaq zuq ziq zeq xoq xaq xuq xiq xeq", "xx", "s", 1)]
    df = spark.createDataFrame(rows + many + tiny, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["lang_pred"] for r in g.identify(df).collect()}
    assert got.pop(rare) == "xx"
    assert set(got.values()) == {"de", "en"}
    assert all(got[i] == ("en" if i % 3 else "de") for i in range(800))


def test_lacking_a_unit_costs_every_language_the_same():
    words = [("en", "the", 50_000, 1_000_000), ("xx", "zoq", 5, 10)]
    grams = [("en", "e", 9, 2_000_000), ("xx", "q", 9, 40)]
    m = g.Model(words, grams)
    assert m.score("the")[1] == m.score("zoq")[0] < m.score("the")[0]
    assert m.score("e")[1] == m.score("q")[0] < m.score("e")[0]


def test_a_language_whose_units_all_tie_keeps_some(spark):
    rows = [("aa", f"w{i}", 1) for i in range(500)] + [("bb", f"v{i}", 2 if i < 4 else 1) for i in range(500)]
    counts = spark.createDataFrame(rows, "lang string, word string, n long")
    top = g._top(counts, "word", 10)
    assert sorted(r[0] for r in top) == ["aa"] * 10 + ["bb"] * 4
    assert all(r in rows for r in [t[:3] for t in top]) and {r[3] for r in top} == {500, 504}
    assert sorted(top) == sorted(g._top(counts.repartition(7), "word", 10))


def test_marks_alone_are_no_language(spark):
    rows = [(i, f"the river and the hills {i}", "en") for i in range(40)] + [(100, "\u0301\u0308 \u0302", None), (101, "\u0301a", None)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in g.identify(spark.createDataFrame(
        rows, "doc_id long, text string, lang string")).collect()}
    assert got[100] == ("und", 0.0) and got[101][0] == "en"


def test_many_languages_never_stop_the_job(spark, monkeypatch):
    monkeypatch.setattr(g, "MAX_LANGUAGES", 20)
    rows = [(i, "hello there my friend " * 5, "en") for i in range(30)] + [(1000 + i, f"dirt{i}", f"x{i:03d}") for i in range(60)]
    got = {r["doc_id"]: r["lang_pred"] for r in g.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == 90 and all(got[i] == "en" for i in range(30))


def test_predictions_equal_brute_force(spark):
    """Words, then longest n-grams from the left, by the docstring's rules, in plain Python."""
    import math
    import random
    from collections import Counter

    rng = random.Random(3)
    stock = {"en": "the river ran and boats waited near stones".split(), "de": "der fluss lief und boote warten nahe steinen".split(),
             "fr": "la riviere court et les bateaux attendent".split()}
    rows = [(i, " ".join(rng.choice(stock[k]) for _ in range(12)) + (" Zug" if i % 7 == 0 else " riverboats"), k)
            for i in range(120) for k in [("en", "de", "fr")[i % 3]]] + [(500, "steinboot attend unknownword", None), (501, "qqq", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    words, grams = {}, {}
    for i, text, lang in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            for w in text.lower().split():
                words.setdefault(lang, Counter())[w] += 1
                for n in range(1, 6):
                    for at in range(len(w) - n + 1):
                        grams.setdefault(lang, Counter())[w[at:at + n]] += 1
    langs = sorted(words)

    def table(counts):
        floor = -math.log(2 * max(sum(c.values()) for c in counts.values()))
        return floor, {k: {u: math.log(n / sum(c.values())) for u, n in c.items()} for k, c in counts.items()}

    (wf, wt), (gf, gt) = table(words), table(grams)

    def score(w):
        if any(w in wt[k] for k in langs):
            return [wt[k].get(w, wf) for k in langs]
        out, at = [0.0] * len(langs), 0
        while at < len(w):
            for n in range(min(5, len(w) - at), 0, -1):
                if any(w[at:at + n] in gt[k] for k in langs):
                    out = [a + gt[k].get(w[at:at + n], gf) for a, k in zip(out, langs)]
                    break
            else:
                n, out = 1, [a + gf for a in out]
            at += n
        return out

    for r in g.identify(df).collect():
        text = next(t for i, t, _ in rows if i == r["doc_id"]).lower().split()
        sums = [sum(x) for x in zip(*map(score, text))]
        best = max(range(len(langs)), key=lambda k: (sums[k], -k))
        share = 1 / sum(math.exp((s - sums[best]) / math.sqrt(len(text))) for s in sums)
        assert r["lang_pred"] == langs[best] and abs(r["score"] - share) < 1e-9
