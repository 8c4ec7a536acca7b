import random
from functools import lru_cache

from barlake.llm import token_counts as t
from tests.llm.conftest import LONG


def brute(word, scores, unknown):
    """Best (score, -tokens) over all segmentations."""
    @lru_cache(None)
    def best(end):
        if not end:
            return (0.0, 0)
        out = []
        for start in range(end):
            piece = word[start:end]
            before = best(start)
            if piece in scores:
                out.append((before[0] + scores[piece], before[1] - 1))
            elif end - start == 1:
                size = len(piece.encode())
                out.append((before[0] + unknown * size, before[1] - size))
        return max(out)
    return -best(len(word))[1]


def test_counts_match_brute_force_and_share_prefixes():
    rng = random.Random(2)
    scores = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): -float(rng.randint(1, 9)) for _ in range(40)}
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(400)})
    counter = t.PrefixCounter(scores)
    assert counter.count(words) == [brute(w, scores, counter.unknown) for w in words]
    assert counter.nodes == len({w[:k] for w in words for k in range(1, len(w) + 1)})


def test_agrees_with_a_public_unigram_decoder():
    from tokenizers import Tokenizer, models
    pieces = t.load_pieces()
    decoder = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces.items()], unk_id=0, byte_fallback=False))
    words = sorted({t.WORD_MARK + w for w in "the quick brown foxes unbelievably internationalisation zu Straße niño".split()})
    for word, n in zip(words, t.PrefixCounter(pieces).count(words)):
        found = decoder.encode(word).tokens
        assert sum(pieces[x] for x in found) == _score(word, pieces) and n <= len(found)


def _score(word, pieces):
    best = [0.0] + [float("-inf")] * len(word)
    for end in range(1, len(word) + 1):
        best[end] = max(best[s] + pieces[word[s:end]] for s in range(end) if word[s:end] in pieces)
    return best[-1]


def test_odd_and_empty_tables(odd, none):
    got = t.token_counts(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_tokens"] == by[2]["n_tokens"] == by[3]["n_pretokens"] == 0
    assert by[4]["n_bytes"] == len(LONG) and by[4]["n_pretokens"] == 30_000
    assert t.token_counts(none).count() == 0


def test_small_table_gives_the_same_counts(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"alpha beta{i} gamma delta{i % 3}") for i in range(50)], "doc_id long, text string")
    full = sorted(map(tuple, t.token_counts(df).collect()))
    monkeypatch.setattr(t, "TABLE_WORDS", 5)
    assert sorted(map(tuple, t.token_counts(df.repartition(7)).collect())) == full


def test_ordinary_words_are_one_token(spark):
    words = "the language of international trade is an extraordinary subject".split()
    df = spark.createDataFrame([(i, " ".join(words[i % 4:])) for i in range(40)], "doc_id long, text string")
    assert all(r["n_tokens"] == r["n_pretokens"] for r in t.token_counts(df).collect())


def test_scores_are_log_probabilities_of_counts_over_all_rows(spark):
    import math
    df = spark.createDataFrame([(i, "the the language") for i in range(30)] + [(99, None)], "doc_id long, text string").repartition(5)
    scores = t.unigram_scores(df)
    assert t.holds_ranks(t.load_pieces()) and not t.holds_ranks(scores)
    assert abs(sum(map(math.exp, scores.values())) - 1) < 1e-9
    assert abs(scores["▁the"] - math.log(61 / (90 + len(scores)))) < 1e-12
    assert scores["▁the"] > scores["▁language"] > scores["▁zero"]
