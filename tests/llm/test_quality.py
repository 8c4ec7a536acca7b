import random
import re

from barlake.llm import quality_cascade as q


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    where = {}
    for i in range(len(words) - 4):
        where.setdefault(tuple(words[i:i + 5]), []).append(i)
    covered = {k for at in where.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


def test_features_match_brute_force(spark, odd):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "bb", "c#", "\n", " ", "  ", "\t", "é|", "a b c d e "]) for _ in range(rng.randint(0, 120)))
             for _ in range(150)] + [r["text"] for r in odd.select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:7] for r in q.quality_rows(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_junk_goes_and_prose_stays(spark):
    prose = "The river rose in the night, and by morning two of the lower fields were under water again this year."
    junk = ["a*** b### c$$$ d%%% e&&& f*** g### h$$$ i%%% j&&& k***", "ONE!! TWO!! THREE!! FOUR!! FIVE!! SIX!! SEVEN!! EIGHT!! NINE!! TEN!! OH!!",
            "x x x x y y y y z z z z w w w w", "a | b | c | d | e | f | g | h | i | j | k | l"]
    df = spark.createDataFrame([(0, prose)] + [(i + 1, j) for i, j in enumerate(junk)], "doc_id long, text string")
    assert [r["doc_id"] for r in q.quality_filter(df).collect()] == [0]


def test_order_is_by_rejection_per_cost_and_never_changes_the_verdict(spark):
    df = spark.createDataFrame([(i, "word " * (i % 30) + "x*** " * (i % 7)) for i in range(300)], "doc_id long, text string")
    found = q.measure(df, sample_rows=200)
    assert {m.rule.name for m in found} == {r.name for r in q.RULES}
    f = q.Features(df["text"])
    a = {r["doc_id"]: r["k"] for r in df.select("doc_id", q.cascade(q.RULES, f)[0].alias("k")).collect()}
    b = {r["doc_id"]: r["k"] for r in df.select("doc_id", q.cascade(q.RULES[::-1], f)[0].alias("k")).collect()}
    assert a == b


def test_odd_and_empty_tables(odd, none):
    assert q.quality_rows(odd).count() == odd.count()
    assert q.quality_filter(odd).columns == odd.columns
    assert q.quality_rows(none).count() == 0 and q.quality_filter(none).count() == 0


def test_split_features_equal_those_of_the_text(spark, odd):
    texts = [r["text"] for r in odd.select("text").collect()] + ["a a b\n a a b\nc", "x!! y", "#* one two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_stutter_words")
    plain = q.Features(df["text"])
    from pyspark.sql import functions as F
    once = q.split(df["text"], lambda f: F.struct(*[getattr(f, n).alias(n) for n in names]))
    for r in df.select(F.struct(*[getattr(plain, n).alias(n) for n in names]).alias("a"), once.alias("b")).collect():
        assert r["a"] == r["b"]


def test_filter_and_rows_agree(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = {r["doc_id"] for r in q.quality_rows(df).filter("kept").collect()}
    assert kept == {r["doc_id"] for r in q.quality_filter(df).collect()}
