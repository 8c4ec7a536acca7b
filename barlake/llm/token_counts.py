"""Unigram token counts by dynamic programming over a trie of pre-tokens.

Pre-tokens are the words ``[^\\x20\\x09-\\x0D]+`` of the whole text, each with the
word mark in front.  The distinct ones of a batch are walked in sorted order, which
is the depth-first order of their trie: the path down to the current node holds the
best forward score and token count of every prefix, a word that shares a prefix
with the one before starts from the shared node, and the last node of a word (its
terminal) gives the word's count.  A text's count is the sum over its words, so a
word costs one dictionary lookup after its first sight.

Scores are unigram log probabilities.  A vocabulary file of the Unigram kind holds
them.  A BPE file holds merge ranks, which are no probabilities, so only its pieces
count: tasks count the pieces of their own rows as the file's own encoder cuts them,
Spark sums the counts over the whole table, and a piece scores
``log((count + 1) / (all counts + pieces))``.  The counts then depend on the table.

The best segmentation has the highest sum of piece scores, and among equal sums the
fewest tokens.  A character that no piece covers counts as one token per UTF-8
byte, at ``UNKNOWN_PENALTY`` below the lowest score.

Null and empty texts have no pre-token and count 0.  Very long words cost time and
memory in proportion to their length; the table of known words is emptied when it
holds ``TABLE_WORDS`` words, which changes no count.  Repeated rows are counted one
by one, an empty table gives an empty result, other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm.common import byte_texts, slices

WORD_MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Pre-tokens that a task keeps counts of.
TABLE_WORDS = 1_000_000
#: Longest vocabulary file that is shipped to the tasks, in pieces.
MAX_PIECES = 2_000_000


def _model(path: str | None = None):
    import sentencepiece

    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece.SentencePieceProcessor(model_file=str(path))


def load_pieces(path: str | None = None) -> dict[str, float]:
    """Scores in the file of the ordinary pieces of a sentencepiece model (default:
    the installed public 32k model)."""
    model = _model(path)
    size = model.get_piece_size()
    if size > MAX_PIECES:
        raise ValueError(f"{size} pieces are more than a task should hold ({MAX_PIECES})")
    return {model.id_to_piece(i): model.get_score(i) for i in range(size)
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}


def holds_ranks(pieces: dict[str, float]) -> bool:
    """True for the scores of a BPE file: whole numbers only."""
    return len(pieces) > 1 and all(s == int(s) for s in pieces.values())


def piece_counts(df: DataFrame, text: str, proto: bytes) -> DataFrame:
    """(piece, n): pieces of all pre-tokens as the model cuts them, repeats counted."""
    shared = df.sparkSession.sparkContext.broadcast(proto)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        ids: Counter = Counter()
        words: Counter = Counter()

        def encode() -> None:
            for (_, n), cut in zip(words.items(), model.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)):
                for i in cut:
                    ids[i] += n
            words.clear()

        for batch in slices(batches, "_text"):
            for t in byte_texts(batch, "_text"):
                words.update(t.split())
            if len(words) > TABLE_WORDS:
                encode()
        encode()
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([model.id_to_piece(i) for i in ids], pa.string()),
                                              pa.array(list(ids.values()), pa.int64())], names=["piece", "n"])

    return df.select(df[text].alias("_text")).mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def unigram_scores(df: DataFrame, text: str = "text", vocabulary: str | None = None) -> dict[str, float]:
    """Log probability of each piece: the file's, or from counts over the whole table."""
    pieces = load_pieces(vocabulary)
    if not holds_ranks(pieces):
        return pieces
    counts = {r["piece"]: r["n"] for r in piece_counts(df, text, _model(vocabulary).serialized_model_proto()).collect()
              if r["piece"] in pieces}  # MAX_PIECES rows at most
    whole = sum(counts.values()) + len(pieces)
    return {p: math.log((counts.get(p, 0) + 1) / whole) for p in pieces}


class PrefixCounter:
    """Counts of words, by forward scores along a depth-first walk of their trie."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        #: Nodes that were computed, to show the sharing.
        self.nodes = 0

    def count(self, words: list[str]) -> list[int]:
        """Token counts of ``words``, which are distinct and sorted."""
        scores, longest, unknown = self.scores, self.longest, self.unknown
        best: list[float] = [0.0]
        tokens: list[int] = [0]
        before = ""
        out = []
        for word in words:
            shared = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                shared += 1
            del best[shared + 1:], tokens[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                char = word[end - 1]
                size = 1 if char in scores else len(char.encode("utf-8", "surrogatepass"))
                top, fewest = best[end - 1] + scores.get(char, unknown * size), tokens[end - 1] + size
                for start in range(max(0, end - longest), end - 1):
                    s = scores.get(word[start:end])
                    if s is not None:
                        s += best[start]
                        if s > top or s == top and tokens[start] < fewest:
                            top, fewest = s, tokens[start] + 1
                best.append(top)
                tokens.append(fewest)
            self.nodes += len(word) - shared
            before = word
            out.append(tokens[-1])
        return out


def token_counts(df: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Per document: id, n_bytes, n_pretokens, n_tokens of the whole text."""
    spark: SparkSession = df.sparkSession
    pieces = spark.sparkContext.broadcast(unigram_scores(df, text, vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(pieces.value)
        known: dict[bytes, int] = {}
        for batch in slices(batches, "_text"):
            texts = byte_texts(batch, "_text")
            docs = [t.split() for t in texts]
            new = sorted({(WORD_MARK + w.decode("utf-8", "replace"), w) for d in docs for w in set(d) if w not in known})
            if len(known) + len(new) > TABLE_WORDS:
                known = {}
                new = sorted({(WORD_MARK + w.decode("utf-8", "replace"), w) for d in docs for w in set(d)})
            known.update(zip([w for _, w in new], counter.count([s for s, _ in new])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([len(d) for d in docs], pa.int64()),
                 pa.array([sum(map(known.__getitem__, d)) for d in docs], pa.int64())],
                names=["_id", "n_bytes", "n_pretokens", "n_tokens"])

    narrow = df.select(df[id_col].alias("_id"), df[text].alias("_text"))
    kind = narrow.schema["_id"].dataType.simpleString()
    out = narrow.mapInArrow(count, f"_id {kind}, n_bytes long, n_pretokens long, n_tokens long")
    return out.withColumnRenamed("_id", id_col)
