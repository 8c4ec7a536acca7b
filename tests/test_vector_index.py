"""Inverted index: recall against the exact search, chunks, odd vectors."""
import numpy as np
from pyspark.sql import functions as F

from barlake.operators import retrieval as rv
from barlake.operators import vector_index as vi
from barlake.plans import retrievalplans as rp


def _vectors(spark, n=1500, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    rows = [(int(i), [float(x) for x in centres[rng.integers(20)] + 0.4 * rng.normal(size=dim)]) for i in range(n)]
    return spark.createDataFrame(rows + [(n, [0.0] * dim), (n + 1, None)], "id long, vec array<float>")


def _q(df):
    return df.where(F.col("id") % 20 == 0).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


def test_recall_and_exact_similarities(spark):
    df = _vectors(spark)
    index = vi.fit_index(df, 10)
    assert 1 <= index.probes < len(index.centres)
    found = vi.search(_q(df), df, index, 10, exclude_self=True)
    exact = rv.vector_topk(_q(df), df.where("vec IS NOT NULL"), 10, exclude_self=True)
    r = vi.recall(found, exact).first()
    assert r.n_queries == 75 and r.recall >= 0.9
    sims = {(x.qid, x.id): x.similarity for x in exact.collect()}
    assert all(abs(sims[(x.qid, x.id)] - x.similarity) < 1e-9 for x in found.collect() if (x.qid, x.id) in sims)


def test_all_lists_probed_is_exact_and_chunks_do_not_matter(spark):
    df = _vectors(spark, 400)
    index = vi.fit_index(df, 5, centres=7)
    every = vi.VectorIndex(index.centres, len(index.centres))
    rows = lambda x: sorted((r.qid, r["rank"], r.id, round(r.similarity, 9)) for r in x.collect())
    want = rows(rv.vector_topk(_q(df), df.where("vec IS NOT NULL"), 5, exclude_self=True).select("qid", "rank", "id", "similarity"))
    assert rows(vi.search(_q(df), df, every, 5, exclude_self=True)) == want
    assert rows(vi.search(_q(df), df, every, 5, exclude_self=True, chunk=16)) == want


def test_empty_collection(spark):
    df = _vectors(spark, 30)
    none = df.limit(0)
    index = vi.fit_index(none, 5)
    assert vi.search(_q(df), none, index, 5).count() == 0


def test_query_reaches_its_recall(spark):
    for sf in ("sf0.001", "sf0.01"):
        assert rp.approx_recall(spark, f"/root/testdata/{sf}").first().recall_reached
