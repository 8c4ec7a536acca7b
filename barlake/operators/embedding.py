"""Text encoders (I13) and approximate neighbours.

The built-in encoder is JVM-side pyspark.ml: regex tokens → hashed term
frequencies → L2 normalisation → ``array<float>``.  A model encoder can be
plugged in as an iterator pandas UDF that loads the model once per worker
(``encoder_udf``); batches arrive through Arrow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hashing_encoder(df: DataFrame, text: str, out: str, dim: int = 1024) -> DataFrame:
    tok = RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"\W+", minTokenLength=1)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim)
    nm = Normalizer(inputCol="_tf", outputCol="_nv", p=2.0)
    x = nm.transform(tf.transform(tok.transform(df)))
    return x.withColumn(out, vector_to_array("_nv", "float32")).drop("_tok", "_tf", "_nv")


# Labels of the embedding texts
PART_TYPE, PART_TIMEFRAME, PART_DIRECTION, PART_SUMMARY = "類型", "時間框架", "方向", "概要"
PART_NOTES = "備註"
SUMMARY_CHARS = 50


def embedding_parts(lib: DataFrame, metadata_chars: int | None = None, semantic_chars: int | None = None) -> DataFrame:
    """Three texts of a library entry, each of one kind: what it is (type, timeframe,
    direction, a short summary), what it means (description, notes) and its code.
    Without limits nothing is cut but the summary."""

    def cut(text, n):
        return text if n is None else F.substring(text, 1, n)

    line = lambda label, *v: F.concat(F.lit(f"{label}: "), F.concat_ws(" ", *v))
    meta = F.concat_ws("\n", line(PART_TYPE, "holding_type", "category"), line(PART_TIMEFRAME, "timeframe"),
                       line(PART_DIRECTION, "direction"), line(PART_SUMMARY, F.substring("description", 1, SUMMARY_CHARS)))
    means = F.concat_ws("\n", "description", line(PART_NOTES, F.coalesce("notes", F.lit(""))))
    return lib.withColumns({"metadata_text": cut(meta, metadata_chars), "semantic_text": cut(means, semantic_chars),
                            "code_text": F.col("code")})


INDEX_SCHEMA = "stem string, name string, category string, semantic_vector array<float>, metadata_vector array<float>, folder string"


def index_library(spark, root: str, path: str, folder: str | None = None, dry_run: bool = False, dim: int = 256) -> int:
    """Library entries → texts → vectors → stored collection, replaced by (folder,
    stem) in the partitions of their folders.  Returns the number of entries; a dry run
    stores none."""
    from barlake.operators.retrieval import check_dim
    from barlake.session import materialize
    from barlake.sources.bars_csv import load_strategy_library
    from barlake.sources.stored import stored_upsert
    lib = materialize(load_strategy_library(spark, root)[0])    # files are read and parsed once
    if folder is not None:
        lib = lib.where(F.col("folder") == folder)
    x = embedding_parts(lib)
    for text, out in (("metadata_text", "metadata_vector"), ("semantic_text", "semantic_vector")):
        x = hashing_encoder(x, text, out, dim)
    if dry_run:
        return lib.count()
    rows = x.select("stem", "name", "category", "semantic_vector", "metadata_vector", "folder")
    return stored_upsert(rows, path, ["folder", "stem"], "folder", check=lambda d: check_dim(d, "semantic_vector", dim),
                         rejects=f"{path}-rejects").count()


def encoder_udf(load: Callable[[], Callable[[list[str]], np.ndarray]], dim: int):
    """Wrap a model loader as an iterator pandas UDF returning unit float vectors."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()                     # once per worker process
        for s in batches:
            v = np.asarray(model(s.fillna("").tolist()), dtype=np.float32)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            v = np.where(n > 0, v / n, v)
            yield pd.Series(list(v[:, :dim]))
    return enc


def approx_topk(queries: DataFrame, collection: DataFrame, k: int, q_id: str = "qid", q_vec: str = "qvec",
                c_id: str = "id", c_vec: str = "vec", bucket_length: float = 0.5, tables: int = 4,
                max_distance: float = 1.0, seed: int = 7) -> DataFrame:
    """Approximate neighbours with random-projection LSH on unit vectors
    (Euclidean distance d ↔ cosine 1 - d²/2).  Candidates are pairs sharing a
    bucket in any table within ``max_distance``; recall is measured against
    the exact :func:`barlake.operators.retrieval.vector_topk`."""
    def unit(df, idc, vc):
        v = F.transform(vc, lambda x: x.cast("double"))
        n = F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda a, b: a + b))
        return df.select(F.col(idc).alias("_id"), array_to_vector(F.transform(v, lambda x: x / n)).alias("features"))
    q = unit(queries, q_id, q_vec)
    c = unit(collection, c_id, c_vec)
    lsh = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket_length,
                                      numHashTables=tables, seed=seed).fit(c)
    pairs = lsh.approxSimilarityJoin(q, c, max_distance, distCol="dist")
    x = pairs.select(F.col("datasetA._id").alias(q_id), F.col("datasetB._id").alias(c_id), "dist") \
        .where(F.col(q_id) != F.col(c_id))
    from pyspark.sql import Window
    w = Window.partitionBy(q_id).orderBy("dist", c_id)
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        q_id, "rank", c_id, (F.lit(1.0) - F.col("dist") * F.col("dist") / 2).alias("similarity"))
