"""Exact top-k against brute force, in one or several broadcast batches."""
import numpy as np

from barlake.operators import retrieval as rv


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(60, 8)).astype("float32")
    rows = [(i, vecs[i].tolist(), i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, vec array<float>, g int").repartition(4)
    q = df.selectExpr("id as qid", "vec as qvec", "g as qg")
    u = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    sims = u.astype("float64") @ u.T.astype("float64")
    for rows in (2048, 7):   # 7 rows per block/chunk forces many co-grouped steps
        got = rv.vector_topk(q, df, 4, match=[("qg", "g")], exclude_self=True, block_rows=rows).collect()
        by_q = {}
        for r in got:
            by_q.setdefault(r.qid, []).append((r.rank, r.id))
        for i in range(60):
            cand = [j for j in range(60) if j != i and j % 3 == i % 3]
            exp = sorted(cand, key=lambda j: (-sims[i, j], j))[:4]
            assert [j for _, j in sorted(by_q[i])] == exp


def test_mean_pairwise_exact(spark):
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(12, 5))
    df = spark.createDataFrame([(i % 2, vecs[i].tolist()) for i in range(12)], "b int, v array<double>")
    got = {r.b: r.mean_similarity for r in rv.mean_pairwise_similarity(df, ["b"], "v").collect()}
    u = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    for b in (0, 1):
        idx = [i for i in range(12) if i % 2 == b]
        pairs = [u[i] @ u[j] for k, i in enumerate(idx) for j in idx[k + 1:]]
        assert abs(got[b] - np.mean(pairs)) < 1e-12


def test_diversity_filter(spark):
    rows = [(1, 10, 3.0, [1.0, 0.0]), (1, 11, 2.0, [0.99, 0.1]), (1, 12, 1.0, [0.0, 1.0]), (1, 13, 0.5, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "qid int, id int, sharpe double, v array<double>")
    got = [r.id for r in rv.diversity_filter(df, ["qid"], "v", "id", "sharpe", 0.85, 3).orderBy("pick").collect()]
    assert got == [10, 12, 13]


def test_topk_with_copies_and_missing_vectors(spark):
    """Many equal vectors, repeated ids, rows without a vector or direction; blocks of the default size."""
    rng = np.random.default_rng(7)
    vecs = rng.normal(size=(6000, 8)).astype("float32")
    vecs[1000:4000] = vecs[0]
    ids = [*range(5990), *range(10)]
    rows = [(i, v.tolist()) for i, v in zip(ids, vecs)] + [(7000, None), (7001, [0.0] * 8), (None, vecs[0].tolist())]
    df = spark.createDataFrame(rows, "id long, vec array<float>").repartition(4)
    q = df.where("id % 500 = 3 OR id >= 7000 OR id IS NULL").selectExpr("id as qid", "vec as qvec")
    u = vecs.astype("float64") / np.linalg.norm(vecs.astype("float64"), axis=1, keepdims=True)
    got = {}
    for r in rv.vector_topk(q, df, 5, exclude_self=True).collect():
        got.setdefault(r.qid, []).append((r.rank, r.id, round(r.similarity, 9)))
    assert set(got) == {i for i in ids if i % 500 == 3}
    for i in got:
        found = []
        for at in [n for n, x in enumerate(ids) if x == i]:     # a repeated id asks once per row
            s = u @ u[at]
            found += sorted((-round(s[n], 12), ids[n]) for n in range(len(ids)) if ids[n] != i)[:5]
        assert [(x, s) for _, x, s in sorted(got[i])] == [(x, round(-s, 9)) for s, x in sorted(found)[:5]]


def test_topk_steps_of_a_large_collection(spark):
    """40 000 items are one chunk of an Arrow step: a query is sent once, not once per 2048 items."""
    df = spark.range(40_000).selectExpr("id", "array(cast(id % 7 + 1 as float), cast(id % 11 as float)) as vec")
    top = rv.vector_topk(df.where("id < 100").selectExpr("id as qid", "vec as qvec"), df, 3)
    assert "FlatMapCoGroupsInArrow" in top._jdf.queryExecution().toString()
    assert rv.DEFAULT_BLOCK_ROWS * rv.CHUNK_BLOCKS >= 40_000
    assert top.count() == 300
