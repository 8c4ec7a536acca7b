"""Vector retrieval over strategy collections.

Exact cosine top-k without emitting query × item pairs as rows: queries are
hashed into blocks of about ``DEFAULT_BLOCK_ROWS`` rows and the collection into
chunks of ``CHUNK_BLOCKS`` times as many; every (block, chunk) pair is one
co-grouped Arrow step emitting only the k best of each query; a final
``row_number`` per query keeps the global top k (a query's group holds at most
k × chunks rows).  Order: similarity desc, then id asc — the same total order
in the partial and final steps, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_BLOCK_ROWS = 8192  # queries per block of one co-grouped step
CHUNK_BLOCKS = 8           # items per chunk, in blocks: long chunks keep the partial results few
TILE_QUERIES, TILE_ITEMS, TILE_PAIRS = 128, 4096, 32_768  # what a step multiplies, and scores again, at a time


def _unit(mat: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(mat, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0, mat / n, np.nan)


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as unit vectors (nan: no direction)."""
    n = len(vectors)
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in vectors.chunks] or [np.zeros(0)])
    return _unit(flat.astype(np.float64).reshape(n, -1 if n else 0))


def _places(of: np.ndarray) -> np.ndarray:
    """The place of each element among its equals, for a sorted array."""
    return np.arange(len(of)) - np.searchsorted(of, of, side="left")


def _without_copies(ids: np.ndarray, units: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the ``k`` nearest of any query, for rows in id order: of equal
    vectors the first ``k``, and as many more as rows of one id can be left out as the query's own."""
    odd = np.random.default_rng(0).integers(0, 1 << 63, units.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = (np.ascontiguousarray(units).view(np.uint64) * odd).sum(axis=1, dtype=np.uint64)
    order = np.argsort(mixed, kind="stable")
    place = _places(mixed[order])
    spare = np.nonzero(place >= k + 1 + _places(ids).max(initial=0))[0]
    first = order[spare - place[spare]]
    keep = np.ones(len(ids), dtype=bool)
    keep[order[spare]] = ~(units[order[spare]] == units[first]).all(axis=1)
    return keep


def _nearest(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int, exclude_self: bool):
    """The ``k`` nearest items (rows in id order) of each query: query row, item row, similarity.

    Tiles of single-precision similarities only rule out pairs: those below the query's
    k-th best so far by more than the rounding error.  What is left is scored again, pair
    by pair in double precision, and decides."""
    q4, c4 = q.astype(np.float32), c.astype(np.float32)
    slack = np.float32(4 * (q.shape[1] + 4) * 2.0 ** -24)       # twice the error bound of a unit dot product
    lowest = np.finfo(np.float32).min
    out = []
    for a in range(0, len(qids), TILE_QUERIES):
        some = q4[a:a + TILE_QUERIES]
        lo, hi = (np.searchsorted(ids, qids[a:a + TILE_QUERIES], side=s) for s in ("left", "right"))
        own = np.repeat(np.arange(len(some)), hi - lo)
        own_item = np.arange(len(own)) - np.repeat(np.cumsum(hi - lo) - hi, hi - lo)
        floor = np.full(len(some), lowest)
        row, item, sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        for b in range(0, len(ids), TILE_ITEMS):
            sims = some @ c4[b:b + TILE_ITEMS].T
            if exclude_self:
                here = (own_item >= b) & (own_item < b + sims.shape[1])
                sims[own[here], own_item[here] - b] = -np.inf
            if not b and sims.shape[1] > k:
                floor = np.maximum(np.partition(sims, -k, axis=1)[:, -k] - slack, lowest)
            r, i = np.divmod(np.flatnonzero(sims >= floor[:, None]), sims.shape[1])
            if not len(r):
                continue
            row, item, sim = np.concatenate([row, r]), np.concatenate([item, i + b]), np.concatenate([sim, sims[r, i]])
            order = np.lexsort((-sim, row))
            row, item, sim = row[order], item[order], sim[order]
            kth = _places(row) == k - 1
            floor[row[kth]] = np.maximum(sim[kth] - slack, lowest)
            near = sim >= floor[row]
            row, item, sim = row[near], item[near], sim[near]
        exact = np.concatenate([np.zeros(0)] + [np.einsum("ij,ij->i", q[a + row[n:n + TILE_PAIRS]], c[item[n:n + TILE_PAIRS]])
                                                for n in range(0, len(row), TILE_PAIRS)])
        order = np.lexsort((item, -exact, row))
        order = order[_places(row[order]) < k]
        out.append((row[order] + a, item[order], exact[order]))
    return tuple(np.concatenate(x) for x in zip(*out))


def vector_topk(queries: DataFrame, collection: DataFrame, k: int, *, q_id: str = "qid",
                q_vec: str = "qvec", c_id: str = "id", c_vec: str = "vec",
                match: Sequence[tuple[str, str]] = (), exclude_self: bool = False,
                block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """For each query the ``k`` most cosine-similar collection rows.

    ``match`` lists ``(query column, collection column)`` pairs that must be
    equal (per-query pre-filters, e.g. same session).  Collection-wide filters
    are applied by the caller before (they reach the scan).  Returns
    ``q_id, rank, c_id, similarity, distance``.

    Within each group of equal match columns, queries are hashed into blocks of
    about ``block_rows`` rows and the collection into chunks of ``CHUNK_BLOCKS``
    times as many; every (block, chunk) pair is one co-grouped Arrow step that
    keeps each query's k best (similarity desc, id asc).  Nothing passes through
    the driver; a group holds at most one block and one chunk, and multiplies
    them tile by tile.  Rows without an id or a vector take no part.
    """
    keys = [f"_m{i}" for i in range(len(match))]
    qsel = queries.select(F.col(q_id).cast("long").alias("_qid"), F.col(q_vec).alias("_qv"),
                          *[F.col(a).alias(m) for m, (a, _) in zip(keys, match)]).where("_qid IS NOT NULL AND _qv IS NOT NULL")
    coll = collection.select(F.col(c_id).cast("long").alias("_id"), F.col(c_vec).alias("_cv"),
                             *[F.col(b).alias(m) for m, (_, b) in zip(keys, match)]).where("_id IS NOT NULL AND _cv IS NOT NULL")
    # blocks and chunks are counted per group of equal match columns, so a filter
    # that keeps a quarter of the pairs also copies and multiplies only a quarter
    n_q, n_c = qsel.groupBy(*keys).agg(F.count("*").alias("_nq")), coll.groupBy(*keys).agg(F.count("*").alias("_nc"))
    n_qb = F.greatest(F.ceil(F.col("_nq") / block_rows), F.lit(1)).alias("_nqb")
    n_cc = F.greatest(F.ceil(F.col("_nc") / (block_rows * CHUNK_BLOCKS)), F.lit(1)).alias("_ncc")
    sizes = n_q.join(n_c, keys).select(*keys, n_qb, n_cc) if keys else \
        {"_nqb": F.lit(n_q.select(n_qb).first()[0]), "_ncc": F.lit(n_c.select(n_cc).first()[0])}

    def sized(df: DataFrame) -> DataFrame:
        return df.join(sizes, keys) if keys else df.withColumns(sizes)

    # the vector is hashed too: rows that share an id need not share a group
    qk = sized(qsel).withColumn("_qb", F.pmod(F.xxhash64("_qid", "_qv"), F.col("_nqb"))) \
        .withColumn("_cc", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_ncc") - 1))).drop("_nqb", "_ncc")
    ck = sized(coll).withColumn("_cc", F.pmod(F.xxhash64("_id", "_cv"), F.col("_ncc"))) \
        .withColumn("_qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nqb") - 1))).drop("_nqb", "_ncc")

    def block_topk(qs: pa.Table, cs: pa.Table) -> pa.Table:
        found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        qids, ids = qs["_qid"].to_numpy(), cs["_id"].to_numpy()
        if len(qids) and len(ids):
            order = np.argsort(ids, kind="stable")
            ids, q, c = ids[order], _matrix(qs["_qv"]), _matrix(cs["_cv"])[order]
            q_ok, c_ok = np.isfinite(q).all(axis=1), np.isfinite(c).all(axis=1)
            qids, q, ids, c = qids[q_ok], q[q_ok], ids[c_ok], c[c_ok]
            keep = _without_copies(ids, c, k)
            ids, c = ids[keep], c[keep]
            if len(qids) and len(ids):
                row, item, sim = _nearest(qids, q, ids, c, k, exclude_self)
                found = qids[row], ids[item], sim
        return pa.table({"_qid": found[0], "_id": found[1], "_sim": found[2]})

    cand = qk.groupBy(*keys, "_qb", "_cc").cogroup(ck.groupBy(*keys, "_qb", "_cc")) \
        .applyInArrow(block_topk, "_qid long, _id long, _sim double")
    w = Window.partitionBy("_qid").orderBy(F.col("_sim").desc(), F.col("_id"))
    top = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select(F.col("_qid").alias(q_id), "rank", F.col("_id").alias(c_id),
                      F.col("_sim").alias("similarity"), (F.lit(1.0) - F.col("_sim")).alias("distance"))


# --------------------------------------------------------------------------
# column-level vector helpers
# --------------------------------------------------------------------------

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two array columns (JVM-side higher-order functions)."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def check_dim(df: DataFrame, vec: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """A12 data check: (rows with ``size(vec) = dim``, rejects with a reason)."""
    ok = F.size(vec) == dim
    return df.where(ok), df.where(~ok | F.col(vec).isNull()).withColumn(
        "reject_reason", F.format_string(f"vector length %d != {dim}", F.size(vec)))


# --------------------------------------------------------------------------
# set-level operators
# --------------------------------------------------------------------------

def mean_pairwise_similarity(df: DataFrame, group: Sequence[str], vec: str) -> DataFrame:
    """Mean cosine over unordered pairs of each group, exactly, in
    linear time: with unit vectors u, Σ_{i<j} u_i·u_j = (‖Σu‖² − Σ‖u‖²) / 2."""
    group = list(group)
    u = df.select(*group, F.transform(vec, lambda x: x.cast("double")).alias("_v"))
    u = u.withColumn("_n", F.sqrt(dot(F.col("_v"), F.col("_v"))))
    u = u.where(F.col("_n") > 0).withColumn("_u", F.transform("_v", lambda x: x / F.col("_n")))
    e = u.select(*group, F.posexplode("_u").alias("_p", "_x"))
    s = e.groupBy(*group, "_p").agg(F.sum("_x").alias("_s"), F.sum(F.col("_x") * F.col("_x")).alias("_q"))
    g = s.groupBy(*group).agg(F.sum(F.col("_s") * F.col("_s")).alias("_ss"), F.sum("_q").alias("_qq"))
    n = u.groupBy(*group).agg(F.count(F.lit(1)).alias("n_items"))
    out = g.join(n, group, "inner")
    pairs = F.col("n_items") * (F.col("n_items") - 1) / 2
    return out.select(*group, "n_items", F.when(pairs > 0, (F.col("_ss") - F.col("_qq")) / 2 / pairs)
                      .alias("mean_similarity"))


def diversity_filter(cands: DataFrame, group: Sequence[str], vec: str, id_col: str = "id",
                     sharpe: str = "sharpe", threshold: float = 0.85, keep: int = 3) -> DataFrame:
    """Per group (query) walk candidates by Sharpe desc (id asc on ties)
    and keep one unless its cosine to an already kept one exceeds
    ``threshold``; stop at ``keep``.  Groups are the ≤ k candidates of one
    query, so the fold over a collected list is bounded."""
    group = list(group)
    st = F.struct(F.col(sharpe).alias("s"), F.col(id_col).alias("id"), F.col(vec).alias("v"))
    g = cands.groupBy(*group).agg(F.collect_list(st).alias("_c"))
    srt = F.array_sort("_c", lambda a, b: F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1)
                       .when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
    empty = F.array().cast(T.ArrayType(g.schema["_c"].dataType.elementType))

    def step(acc, c):
        clash = F.exists(acc, lambda kept: cosine(kept["v"], c["v"]) > threshold)
        return F.when((F.size(acc) < keep) & ~clash, F.concat(acc, F.array(c))).otherwise(acc)

    kept = g.select(*group, F.aggregate(srt, empty, step).alias("_k"))
    return kept.select(*group, F.posexplode("_k").alias("pick", "_e")).select(
        *group, (F.col("pick") + 1).alias("pick"), F.col("_e.id").alias(id_col), F.col("_e.s").alias(sharpe))


def fill_short(results: DataFrame, fallback: DataFrame, group: Sequence[str], id_col: str,
               order: Column, n: int = 3) -> DataFrame:
    """Top each group up to ``n`` rows from a fallback list (anti join so a
    fallback row already present is not repeated), ranked after the results."""
    group = list(group)
    fb = fallback.join(results.select(*group, id_col), [*group, id_col], "left_anti")
    u = results.withColumn("_src", F.lit(0)).unionByName(fb.withColumn("_src", F.lit(1)),
                                                         allowMissingColumns=True)
    w = Window.partitionBy(*group).orderBy("_src", order, id_col)
    return u.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= n).drop("_src")


def recall_mrr(ranked: DataFrame, qid: str, hit: Column, rank: str = "rank", k_recall: int = 5,
               k_mrr: int = 20) -> DataFrame:
    """I9/I10 per query: ``hit_at_k`` (any hit in the first k) and
    ``reciprocal_rank`` (1/rank of the first hit within k_mrr, else 0)."""
    r = F.col(rank)
    g = ranked.groupBy(qid).agg(
        F.max(F.when(hit & (r <= k_recall), 1).otherwise(0)).alias("hit_at_k"),
        F.min(F.when(hit & (r <= k_mrr), r)).alias("_first"))
    return g.select(qid, "hit_at_k",
                    F.coalesce(F.lit(1.0) / F.col("_first"), F.lit(0.0)).alias("reciprocal_rank"))


# Retrieval quality targets per phase (Recall@5, MRR)
RETRIEVAL_TARGETS = [(1, 0.60, 0.40), (3, 0.75, 0.50), (5, 0.85, 0.65)]


def gate_retrieval(summary: DataFrame, phase: int = 1) -> DataFrame:
    """Pass when recall and MRR reach the phase's targets."""
    tgt = {p: (r, m) for p, r, m in RETRIEVAL_TARGETS}[phase]
    return summary.withColumns({
        "recall_target": F.lit(tgt[0]), "mrr_target": F.lit(tgt[1]),
        "passed": (F.col("recall_at_5") >= tgt[0]) & (F.col("mrr") >= tgt[1])})


def keyword_hit(expected: Column, text: Column, query: Column, min_len: int = 3,
                case_insensitive: bool = False) -> Column:
    """I9 keyword mode: any expected keyword longer than ``min_len`` occurs in
    the lower-cased text or in the query.  Parity mode does not lower-case the
    keywords (mixed-case ones never match the text)."""
    lt = F.lower(text)

    def one(kw):
        k = F.lower(kw) if case_insensitive else kw
        q = F.lower(query) if case_insensitive else query
        return (F.length(kw) > min_len) & (F.contains(lt, k) | F.contains(q, k))
    return F.exists(expected, one)


def sample_examples(df: DataFrame, category_col: str, category: str, n: int, seed: int = 42,
                    name_col: str = "name") -> DataFrame:
    """Same category first, then the others, in a seeded pseudo-random
    order (md5 of seed and name); the first ``n`` (the limit is the feature)."""
    same = (F.col(category_col) == category).cast("int")
    key = F.md5(F.concat(F.lit(str(seed)), F.col(name_col).cast("string")))
    return df.orderBy(same.desc(), key).limit(n)


def diversify_by_type(ranked: DataFrame, qid: str, type_col: str, score: str = "similarity") -> DataFrame:
    """The best match of each logic type per query."""
    w = Window.partitionBy(qid, type_col).orderBy(F.col(score).desc(), F.col("id"))
    return ranked.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


# Keyword vocabularies mapped to filters
SESSION_KEYWORDS = ["daytrade_day", "daytrade_night", "swing_day", "swing_full"]
LOGIC_KEYWORDS = ["trend", "mean_reversion", "breakout", "opening", "scalp", "pattern"]


def category_filters(expected: Column) -> dict[str, Column]:
    """Session and logic filters from a case's expected keywords (the
    last matching keyword wins)."""
    s = F.filter(expected, lambda k: k.isin(*SESSION_KEYWORDS))
    lg = F.filter(expected, lambda k: k.isin(*LOGIC_KEYWORDS))
    return {"session_filter": F.try_element_at(s, F.lit(-1)), "logic_filter": F.try_element_at(lg, F.lit(-1))}


def sample_examples_by_category(df: DataFrame, category_col: str, n: int, seed: int = 42, name_col: str = "name") -> DataFrame:
    """I15 for every category at once: per target category its own rows first, then the
    others, in the seeded order; the first ``n``.  Only the first ``n`` of each category
    can be among them, so the fill is taken from those (categories squared times n rows)."""
    draw = F.md5(F.concat(F.lit(str(seed)), F.col(name_col).cast("string")))
    own = Window.partitionBy(category_col).orderBy("_draw", name_col)
    few = df.withColumn("_draw", draw).withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= n).drop("_r")
    targets = few.select(F.col(category_col).alias("target")).distinct()
    x = few.withColumn("_one", F.lit(1)).join(targets.withColumn("_one", F.lit(1)), "_one").drop("_one")
    w = Window.partitionBy("target").orderBy(F.col(category_col).eqNullSafe(F.col("target")).desc(), "_draw", name_col)
    return x.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= n).drop("_draw")


def query_text(category: Column, holding_type: Column, timeframe: Column, direction: Column, extra: Column) -> Column:
    """The search text assembled from fields; empty ones leave no line."""
    part = lambda label, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{label}: "), v))
    return F.concat_ws("\n", F.concat(F.lit("Category: "), category), part("Holding Type", holding_type),
                       part("Timeframe", timeframe), part("Direction", direction), part("Requirements", extra))


def find_similar_records(queries: DataFrame, collection: DataFrame, k: int, record: str, schema: str,
                         match: Sequence[tuple[str, str]], **kw) -> DataFrame:
    """I7 for all categories in one call: the k nearest rows that share the query's
    matched columns (none: no row), with their JSON ``record`` read back into columns.
    A record that does not parse is left out, as one that can't be restored is."""
    top = vector_topk(queries, collection, k, match=match, **kw)
    c_id, q_id = kw.get("c_id", "id"), kw.get("q_id", "qid")
    held = collection.select(c_id, F.from_json(F.col(record), schema).alias("_rec"), F.col(record).alias("_raw"))
    whole = F.col("_rec").isNotNull() & (F.json_object_keys("_raw").isNotNull())
    return top.join(held, c_id).where(whole).select(q_id, "rank", c_id, "similarity", "_rec.*")


def find_similar(queries: DataFrame, collection: DataFrame, k: int, **kw) -> DataFrame:
    """Top k for queries whose filtered collection is non-empty (an empty
    collection yields no rows instead of an error)."""
    if collection.limit(1).count() == 0:
        return vector_topk(queries.limit(0), collection, k, **kw)
    return vector_topk(queries, collection, k, **kw)


# Largest stop distance (points) by holding type
STOP_LIMITS = {"daytrade": 150.0, "swing": 250.0}


def stop_limit_ok(stop_points: Column, holding_type: Column) -> Column:
    """Stop distance within the limit of the holding type."""
    lim = F.when(holding_type == "daytrade", F.lit(STOP_LIMITS["daytrade"])).when(
        holding_type == "swing", F.lit(STOP_LIMITS["swing"]))
    return F.coalesce(stop_points <= lim, F.lit(False))
