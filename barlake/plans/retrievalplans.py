"""Named plans: retrieval over the strategy collection derived from ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlake.operators import retrieval as rv
from barlake.plans.common import round_doubles
from barlake.sources import fixtures as fx


def _queries(spark, sf_dir, vec="semantic_vector"):
    d = fx.developed_fx(spark, sf_dir)
    return d.select(F.col("id").alias("qid"), F.col(vec).alias("qvec"),
                    F.col("trading_session").alias("q_session"), F.col("logic_type").alias("q_logic"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each strategy's five nearest others by semantic vector."""
    d = fx.developed_fx(spark, sf_dir)
    top = rv.vector_topk(_queries(spark, sf_dir), d, 5, c_vec="semantic_vector", exclude_self=True)
    return round_doubles(top)


def failed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two nearest failed strategies (label 9 collection) for every strategy."""
    f = fx.failed_fx(spark, sf_dir)
    top = rv.vector_topk(_queries(spark, sf_dir), f, 2, c_vec="semantic_vector", exclude_self=True)
    return round_doubles(top)


def _layered(spark, sf_dir):
    d = fx.developed_fx(spark, sf_dir)
    pool = d.where(~F.col("overfitting_flag"))                      # collection-wide filter
    q = _queries(spark, sf_dir, "metadata_vector")
    meta = rv.vector_topk(q, pool, 20, c_vec="metadata_vector",
                          match=[("q_session", "trading_session"), ("q_logic", "logic_type")], exclude_self=True)
    # Candidates joined back for the semantic stage (≤ 20 per query)
    c = (meta.select("qid", "id")
         .join(d.select("id", "semantic_vector", "sharpe", "logic_type"), "id")
         .join(fx.developed_fx(spark, sf_dir).select(F.col("id").alias("qid"),
                                                     F.col("semantic_vector").alias("qsem")), "qid"))
    c = c.withColumn("similarity", rv.cosine(F.col("semantic_vector"), F.col("qsem")))
    w = Window.partitionBy("qid").orderBy(F.col("similarity").desc(), F.col("id"))
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 5)


def layered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4: not over-fitted, same session and logic type → metadata top 20 → semantic top 5."""
    return round_doubles(_layered(spark, sf_dir).select("qid", "rank", "id", "similarity"))


def diversity_filter(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """I5 on the layered top 5 (threshold 0.3: at 0.85 nothing is ever rejected here)."""
    c = _layered(spark, sf_dir)
    return round_doubles(rv.diversity_filter(c, ["qid"], "semantic_vector", "id", "sharpe",
                                             threshold, 3))


def batch_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D21 per logic type: mean pairwise cosine (exact, linear), diversity
    score 1 − mean, low flag < 0.3, session distribution."""
    d = fx.developed_fx(spark, sf_dir)
    m = rv.mean_pairwise_similarity(d, ["logic_type"], "semantic_vector")
    dist = d.groupBy("logic_type").agg(*[F.count_if(F.col("trading_session") == s).alias(f"n_session_{s}")
                                         for s in range(4)])
    out = m.join(dist, "logic_type").withColumns({
        "diversity_score": F.lit(1.0) - F.col("mean_similarity"),
        "low_diversity": (F.lit(1.0) - F.col("mean_similarity")) < 0.3})
    return round_doubles(out)


def _ranked20(spark, sf_dir):
    d = fx.developed_fx(spark, sf_dir)
    top = rv.vector_topk(_queries(spark, sf_dir), d, 20, c_vec="semantic_vector", exclude_self=True)
    lab = d.select(F.col("id"), F.col("logic_type").alias("c_logic"))
    ql = d.select(F.col("id").alias("qid"), F.col("logic_type").alias("q_logic"))
    return top.join(lab, "id").join(ql, "qid")


def retrieval_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I9–I11, id mode: every strategy is a case, expected = the others of its
    logic type; Recall@5, MRR@20 and the phase-1 gate."""
    r = _ranked20(spark, sf_dir)
    per = rv.recall_mrr(r, "qid", F.col("c_logic") == F.col("q_logic"))
    s = per.agg(F.count(F.lit(1)).alias("n_cases"), F.avg("hit_at_k").alias("recall_at_5"),
                F.avg("reciprocal_rank").alias("mrr"))
    return round_doubles(rv.gate_retrieval(s, 1))


def retrieval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-case hit and reciprocal rank behind :func:`retrieval_eval`."""
    r = _ranked20(spark, sf_dir)
    return round_doubles(rv.recall_mrr(r, "qid", F.col("c_logic") == F.col("q_logic")))


def diversify_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best match of every logic type among each query's top 20."""
    r = _ranked20(spark, sf_dir)
    return round_doubles(rv.diversify_by_type(r, "qid", "c_logic").select(
        "qid", "c_logic", "id", "similarity"))


# Fixed configuration of the two searched collections (I8)
COLLECTIONS = [("developed", 1.0, 5, 0.0), ("failed", 0.5, 2, 0.1)]


def collection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I8: per collection top k above its threshold, merged by weight × similarity."""
    q = _queries(spark, sf_dir)
    outs = []
    for name, weight, k, thr in COLLECTIONS:
        coll = fx.developed_fx(spark, sf_dir) if name == "developed" else fx.failed_fx(spark, sf_dir)
        t = rv.vector_topk(q, coll, k, c_vec="semantic_vector", exclude_self=True)
        outs.append(t.where(F.col("similarity") >= thr).select(
            "qid", F.lit(name).alias("collection"), "id", "similarity",
            (F.lit(weight) * F.col("similarity")).alias("score")))
    u = outs[0].unionByName(outs[1])
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("collection"), F.col("id"))
    return round_doubles(u.withColumn("rank", F.row_number().over(w)))


def fill_short_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layered results above 0.2 similarity, topped up to 3 from the
    unfiltered semantic top 5."""
    lay = _layered(spark, sf_dir).where(F.col("similarity") > 0.2).select("qid", "id", "similarity")
    fb = vector_topk(spark, sf_dir).select("qid", "id", "similarity")
    out = rv.fill_short(lay, fb, ["qid"], "id", F.col("similarity").desc(), 3)
    return round_doubles(out.select("qid", "slot", "id", "similarity"))


def sample_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five examples, logic type 3 first, seeded order (rows-only check)."""
    d = fx.developed_fx(spark, sf_dir).withColumn("name", F.col("id").cast("string"))
    return rv.sample_examples(d, "logic_type", 3, 5).select("id", "logic_type", "sharpe")


def find_similar_trend(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    """Strategies of logic type 3 against the not-over-fitted type-3
    collection (an empty filtered collection yields no rows)."""
    d = fx.developed_fx(spark, sf_dir)
    coll = d.where((F.col("logic_type") == 3) & ~F.col("overfitting_flag"))
    q = _queries(spark, sf_dir).where(F.col("q_logic") == 3)
    return round_doubles(rv.find_similar(q, coll, k, c_vec="semantic_vector", exclude_self=True))


def stop_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop distance against the holding type's limit (day-trading
    sessions 0/1, swing 2/3; stop points derived from the id)."""
    d = fx.developed_fx(spark, sf_dir)
    ht = F.when(F.col("trading_session") < 2, F.lit("daytrade")).otherwise(F.lit("swing"))
    pts = ((F.col("id") * 7) % 300).cast("double")
    x = d.select("id", ht.alias("holding_type"), pts.alias("stop_points"))
    return x.withColumn("within_limit", rv.stop_limit_ok(F.col("stop_points"), F.col("holding_type")))


def retrieve_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per strategy as query three positive examples, the diverse ones of the
    layered search topped up with examples of its session in a seeded order, and two
    failed strategies as negative examples."""
    d = fx.developed_fx(spark, sf_dir)
    good = rv.diversity_filter(_layered(spark, sf_dir), ["qid"], "semantic_vector", "id", "sharpe", 0.85, 3) \
        .select("qid", "id", "pick", F.lit("").alias("draw"))
    draw = F.md5(F.concat(F.lit("42"), F.col("id").cast("string")))
    w = Window.partitionBy("trading_session").orderBy("draw", "id")
    few = d.select("id", "trading_session", draw.alias("draw")).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 7)
    spare = d.select(F.col("id").alias("qid"), "trading_session").join(few, "trading_session").where("qid <> id") \
        .select("qid", "id", F.lit(None).cast("int").alias("pick"), "draw")
    pos = rv.fill_short(good, spare, ["qid"], "id", F.struct("pick", "draw"), 3)
    neg = failed_topk(spark, sf_dir).select("qid", F.col("rank").alias("slot"), "id")
    return pos.select("qid", F.lit("positive").alias("part"), "slot", "id").unionByName(
        neg.select("qid", F.lit("negative").alias("part"), "slot", "id"))


def _keyword_ranked(spark, sf_dir, k: int):
    """Every strategy as a case with expected keywords; sessions and logic types
    among them filter the collection before the search."""
    sess = F.element_at(F.array(*map(F.lit, rv.SESSION_KEYWORDS)), (F.col("trading_session") + 1).cast("int"))
    logic = F.element_at(F.array(*map(F.lit, rv.LOGIC_KEYWORDS)), (F.col("logic_type") % 6 + 1).cast("int"))
    d = fx.developed_fx(spark, sf_dir).withColumns({"sess": sess, "logic": logic})
    i = F.col("id") % 5
    expected = F.when(i == 0, F.array(sess)).when(i == 1, F.array(logic)).when(i == 2, F.array(sess, logic)) \
        .when(i == 3, F.array(F.lit("momentum"))).otherwise(F.array(F.lit("gap"), F.lit("opening")))
    f = rv.category_filters(expected)
    q = d.select(F.col("id").alias("qid"), F.col("semantic_vector").alias("qvec"), expected.alias("expected"),
                 f["session_filter"].alias("qs"), f["logic_filter"].alias("ql"))
    out = None
    for s_on in (False, True):
        for l_on in (False, True):
            part = q.where((F.col("qs").isNotNull() == s_on) & (F.col("ql").isNotNull() == l_on))
            match = [("qs", "sess")] * s_on + [("ql", "logic")] * l_on
            top = rv.vector_topk(part, d, k, c_vec="semantic_vector", match=match, exclude_self=True)
            out = top if out is None else out.unionByName(top)
    text = d.select("id", F.concat_ws(" ", "sess", "logic").alias("text"))
    return q.select("qid", "expected").join(out.select("qid", "id", "rank").join(text, "id"), "qid", "left")


def recall_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I9 keyword mode: share of cases with an expected keyword in one of the top 5."""
    r = _keyword_ranked(spark, sf_dir, 5)
    per = rv.recall_mrr(r, "qid", F.coalesce(rv.keyword_hit(F.col("expected"), F.col("text"), F.lit("")), F.lit(False)))
    return round_doubles(per.agg(F.count(F.lit(1)).alias("n_cases"), F.avg("hit_at_k").alias("recall_at_5")))


def mrr_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I10 keyword mode: mean reciprocal rank of the first hit among the top 20."""
    r = _keyword_ranked(spark, sf_dir, 20)
    per = rv.recall_mrr(r, "qid", F.coalesce(rv.keyword_hit(F.col("expected"), F.col("text"), F.lit("")), F.lit(False)))
    return round_doubles(per.agg(F.count(F.lit(1)).alias("n_cases"), F.avg("reciprocal_rank").alias("mrr")))


def _indexed(spark, sf_dir, k: int):
    """Every strategy whose id is divisible by 20 against the whole indexed collection."""
    from barlake.operators import vector_index as vi
    d = fx.developed_fx(spark, sf_dir)
    q = _queries(spark, sf_dir).where(F.col("qid") % 20 == 0)
    index = vi.fit_index(d, k, vec="semantic_vector")
    return q, d, vi.search(q, d, index, k, c_vec="semantic_vector", exclude_self=True)


def approx_topk(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Ten nearest strategies through the inverted index."""
    return round_doubles(_indexed(spark, sf_dir, k)[2])


def approx_recall(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """I3 against I1 on the same queries: does the index find nine in ten neighbours?"""
    from barlake.operators import vector_index as vi
    q, d, found = _indexed(spark, sf_dir, k)
    exact = rv.vector_topk(q, d, k, c_vec="semantic_vector", exclude_self=True)
    r = vi.recall(found, exact)
    return r.select("n_queries", "n_neighbours", (F.col("recall") >= 0.9).alias("recall_reached"))
