"""Approximate vector search with an inverted index.

Centres are fitted by spherical k-means on a sample of at most ``SAMPLE_ROWS`` rows,
the only vectors that reach the driver.  Every row of the collection is then put in the
list of its nearest centre, and a query looks into the lists of its ``probes`` nearest
centres; there all similarities are computed, so a row that is found has its exact
similarity.  The number of probes is the least that reaches ``TARGET`` recall for
sample rows against the sample itself.

Lists are cut into chunks and the queries of a list into blocks of at most about
``CHUNK`` rows; a task holds one chunk and one block, whatever the size of a list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.operators.retrieval import _unit

#: Rows that centres and probes are fitted on, and centres, at most.
SAMPLE_ROWS = 20_000
MAX_CENTRES = 4096
#: Rounds of k-means, and the sample recall that probes must reach.
ROUNDS = 10
TARGET = 0.97
#: Rows of a chunk of a list, and of a block of its queries.
CHUNK = 2048


@dataclass(frozen=True)
class VectorIndex:
    centres: np.ndarray
    probes: int


def _nearest(units: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of each row, nearest first (rows without a direction: the first)."""
    n = min(n, len(centres))
    if not centres.shape[1]:        # an empty collection has no directions
        return np.zeros((len(units), n), dtype=np.int64)
    sims = np.nan_to_num(units, nan=0.0) @ centres.T
    part = np.argpartition(-sims, n - 1, axis=1)[:, :n]
    order = np.argsort(-np.take_along_axis(sims, part, axis=1), axis=1, kind="stable")
    return np.take_along_axis(part, order, axis=1)


def _k_means(units: np.ndarray, n: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = units[rng.choice(len(units), n, replace=False)]
    for _ in range(rounds):
        of = _nearest(units, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, of, units)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1.0), centres)
    return centres


def _least_probes(units: np.ndarray, centres: np.ndarray, k: int, target: float) -> int:
    """Probes that find ``target`` of the k nearest sample rows of sample rows."""
    queries = units[:: max(1, len(units) // 500)]
    sims = queries @ units.T
    k = min(k + 1, len(units))
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]        # the row itself is among them
    lists = _nearest(units, centres, 1)[:, 0]
    ranked = _nearest(queries, centres, len(centres))
    place = np.empty_like(ranked)
    np.put_along_axis(place, ranked, np.arange(len(centres))[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, lists[best], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)])


def fit_index(collection: DataFrame, k: int, vec: str = "vec", c_id: str = "id", sample_rows: int = SAMPLE_ROWS,
              centres: int | None = None, target: float = TARGET, seed: int = 3) -> VectorIndex:
    """Centres and probes for searches of ``k`` neighbours.  By default the number of
    centres is the square root of the collection's size."""
    rows = collection.count()
    share = min(1.0, sample_rows / max(rows, 1))
    picked = collection.where(F.pmod(F.xxhash64(F.col(c_id), F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))) \
        .orderBy(F.xxhash64(F.col(c_id), F.lit(seed)), c_id).limit(sample_rows).select(vec).collect()
    units = _unit(np.array([r[0] for r in picked if r[0] is not None], dtype=np.float64).reshape(-1, len(picked[0][0]) if picked else 1))
    units = units[np.isfinite(units).all(axis=1)]
    if not len(units):
        return VectorIndex(np.zeros((1, 0)), 1)
    n = max(1, min(centres or int(np.sqrt(rows)), MAX_CENTRES, len(units)))
    made = _k_means(units, n, ROUNDS, seed)
    return VectorIndex(made, _least_probes(units, made, k, target))


def _listed(df: DataFrame, index: VectorIndex, vec: str, n: int) -> DataFrame:
    """Rows with the array of their ``n`` nearest lists (rows without a vector go)."""
    centres = df.sparkSession.sparkContext.broadcast(index.centres)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                units = _unit(np.vstack([np.asarray(v, dtype=np.float64) for v in pdf[vec]]))
                yield pdf.assign(_lists=list(_nearest(units, centres.value, n).astype("int32")))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.where(F.col(vec).isNotNull()).mapInPandas(near, f"{fields}, _lists array<int>")


def search(queries: DataFrame, collection: DataFrame, index: VectorIndex, k: int, q_id: str = "qid", q_vec: str = "qvec",
           c_id: str = "id", c_vec: str = "vec", exclude_self: bool = False, chunk: int = CHUNK) -> DataFrame:
    """q_id, rank, c_id, similarity: the k nearest rows of the lists probed
    (similarity descending, then id)."""
    items = _listed(collection.select(F.col(c_id).cast("long").alias("_id"), F.col(c_vec).alias("_cv")), index, "_cv", 1) \
        .select("_id", "_cv", F.col("_lists")[0].alias("_list"))
    asks = _listed(queries.select(F.col(q_id).cast("long").alias("_qid"), F.col(q_vec).alias("_qv")), index, "_qv", index.probes) \
        .select("_qid", "_qv", F.explode("_lists").alias("_list"))
    # one row per centre
    sizes = items.groupBy("_list").agg(F.ceil(F.count("*") / chunk).alias("_chunks")).join(
        asks.groupBy("_list").agg(F.ceil(F.count("*") / chunk).alias("_blocks")), "_list")
    small = F.broadcast(sizes)
    left = asks.join(small, "_list").withColumn("_block", F.pmod(F.xxhash64("_qid"), F.col("_blocks"))) \
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)))
    right = items.join(small, "_list").withColumn("_chunk", F.pmod(F.xxhash64("_id"), F.col("_chunks"))) \
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))

    def best(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        out = {"_qid": [], "_id": [], "_sim": []}
        if len(qs) and len(cs):
            ids, qids = cs["_id"].to_numpy(), qs["_qid"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            sims = _unit(np.vstack([np.asarray(v, dtype=np.float64) for v in qs["_qv"]])) @ \
                _unit(np.vstack([np.asarray(cs["_cv"].iloc[i], dtype=np.float64) for i in order])).T
            sims = np.where(np.isfinite(sims), sims, -np.inf)
            if exclude_self:
                sims[qids[:, None] == ids[None, :]] = -np.inf
            top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            kept = np.take_along_axis(sims, top, axis=1)
            ok = np.isfinite(kept)
            out = {"_qid": np.repeat(qids, ok.sum(axis=1)), "_id": ids[top][ok], "_sim": kept[ok]}
        return pd.DataFrame(out)

    keys = ["_list", "_chunk", "_block"]
    found = left.select(*keys, "_qid", "_qv").groupBy(*keys).cogroup(right.select(*keys, "_id", "_cv").groupBy(*keys)) \
        .applyInPandas(best, "_qid long, _id long, _sim double")
    w = Window.partitionBy("_qid").orderBy(F.col("_sim").desc(), F.col("_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        F.col("_qid").alias(q_id), "rank", F.col("_id").alias(c_id), F.col("_sim").alias("similarity"))


def recall(found: DataFrame, exact: DataFrame, q_id: str = "qid", c_id: str = "id") -> DataFrame:
    """One row: queries, neighbours that exist, and the share of them that was found."""
    hits = exact.select(q_id, c_id).join(found.select(q_id, c_id).withColumn("_hit", F.lit(1)), [q_id, c_id], "left")
    return hits.agg(F.count_distinct(q_id).alias("n_queries"), F.count(F.lit(1)).alias("n_neighbours"),
                    F.avg(F.coalesce("_hit", F.lit(0)).cast("double")).alias("recall"))
