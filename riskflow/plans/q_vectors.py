"""Registered queries: vectors and similarity search (O-V*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vectors as ov
from . import sql_views as sv
from . import views
from .registry import register

C = sv.with_ctes

NORM_SQL = "sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)))"


@register(
    "l2_normalize",
    f"""SELECT vec_id,
  round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / {NORM_SQL})), 6) AS component_sum,
  round(list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / {NORM_SQL})), 6) AS component_max,
  round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: (x / {NORM_SQL}) * (x / {NORM_SQL}))), 6) AS norm_sq
FROM embeddings""",
)
def l2_normalize(spark, sf_dir):
    """O-V2 over every stored vector (summarised per vector)."""
    e = views.table(spark, sf_dir, "embeddings")
    n = ov.l2_normalize("embedding")
    return e.select("vec_id", n.alias("_n")).select(
        "vec_id",
        F.round(F.aggregate("_n", F.lit(0.0), lambda a, x: a + x), 6).alias("component_sum"),
        F.round(F.array_max("_n"), 6).alias("component_max"),
        F.round(F.aggregate("_n", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm_sq"),
    )


@register(
    "inner_product",
    """SELECT a.vec_id AS vec_id, b.vec_id AS next_id,
  round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS dot
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def inner_product(spark, sf_dir):
    """O-V3: inner product of each vector with the next one (equi self-join)."""
    e = views.table(spark, sf_dir, "embeddings")
    a = e.select(F.col("vec_id"), F.col("embedding").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", "next_id", F.round(ov.dot("a", "b"), 6).alias("dot"))


KNN_SQL = """knn AS (
  SELECT query_id, CAST(rank AS INTEGER) AS rank, case_id, round(score, 4) AS similarity_score FROM (
    SELECT q.query_id, c.case_id, list_dot_product(CAST(q.vector AS DOUBLE[]), CAST(c.vector AS DOUBLE[])) AS score,
      row_number() OVER (PARTITION BY q.query_id
        ORDER BY list_dot_product(CAST(q.vector AS DOUBLE[]), CAST(c.vector AS DOUBLE[])) DESC, c.case_id) AS rank
    FROM query_vectors q, case_vectors c)
  WHERE rank <= 5 AND score >= 0.3)"""


def _knn(spark, sf_dir, k=5, threshold=0.3):
    return ov.similar_cases(views.query_vectors(spark, sf_dir), views.case_vectors(spark, sf_dir), k, threshold)


@register("knn_exact", C(sv.QUERY_VECTORS, sv.CASE_VECTORS, KNN_SQL) + "SELECT * FROM knn")
def knn_exact(spark, sf_dir):
    """O-V4: top-5 cases of every stored vector by inner product, threshold 0.3."""
    return _knn(spark, sf_dir).drop("score")


def _knn_approx(spark, sf_dir):
    return ov.similar_cases_ann(views.query_vectors(spark, sf_dir), views.case_vectors(spark, sf_dir), 5, 0.3)


@register("knn_approx")
def knn_approx(spark, sf_dir):
    """O-V5: inverted-list search (KMeans cells, probes by the cell count) with
    exact rerank.  Approximate, so ``knn_approx_check`` holds it against SQL."""
    return _knn_approx(spark, sf_dir).drop("score")


RECALL_FLOOR = 0.9


@register(
    "knn_approx_check",
    C(sv.QUERY_VECTORS, sv.CASE_VECTORS, KNN_SQL)
    + """SELECT query_id, CAST(count(*) AS BIGINT) AS n_exact, max(similarity_score) AS best, true AS recall_reached FROM knn GROUP BY query_id""",
)
def knn_approx_check(spark, sf_dir):
    """O-V5 against O-V4: per query the number of exact rows and the best score
    that the approximate search found; whether its share of the exact rows
    reaches RECALL_FLOOR over all queries."""
    found = _knn_approx(spark, sf_dir)
    exact = _knn(spark, sf_dir)
    both = exact.select("query_id", "case_id").join(found.select("query_id", "case_id", F.lit(1).alias("hit")), ["query_id", "case_id"], "left")
    recall = both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
    counts = exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_exact"))
    best = found.groupBy("query_id").agg(F.max("similarity_score").alias("best"))
    return counts.join(best, "query_id", "left").select(
        "query_id", "n_exact", "best", F.lit(recall is None or recall >= RECALL_FLOOR).alias("recall_reached")
    )


CASE_META_SQL = """case_meta AS (
  SELECT vec_id AS case_id, CASE WHEN vec_id % 7 = 0 THEN printf('EDGAR-LABEL-%04d', vec_id) ELSE printf('CASE-%05d', vec_id) END AS policy_id,
    'cluster ' || CAST(label AS VARCHAR) AS summary, 'label ' || CAST(label AS VARCHAR) AS outcome FROM embeddings)"""


def _case_meta(spark, sf_dir):
    e = views.case_vectors(spark, sf_dir)
    return e.select(
        "case_id",
        F.when(F.col("case_id") % 7 == 0, F.format_string("EDGAR-LABEL-%04d", "case_id"))
        .otherwise(F.format_string("CASE-%05d", "case_id")).alias("policy_id"),
        F.concat(F.lit("cluster "), F.col("label").cast("string")).alias("summary"),
        F.concat(F.lit("label "), F.col("label").cast("string")).alias("outcome"),
    )


@register(
    "search_response",
    C(sv.QUERY_VECTORS, sv.CASE_VECTORS, KNN_SQL, CASE_META_SQL)
    + """SELECT q.query_id, CAST(count(k.case_id) AS BIGINT) AS n_results,
  max(CASE WHEN k.rank = 1 THEN m.policy_id END) AS top_policy,
  max(CASE WHEN k.rank = 1 THEN CAST(floor(k.similarity_score * 100 + 0.5) AS BIGINT) END) AS top_percent,
  coalesce(bool_or(starts_with(m.policy_id, 'EDGAR-')), false) AS any_filing,
  string_agg(m.policy_id, ',' ORDER BY k.rank) AS policies,
  (SELECT CAST(count(*) AS BIGINT) FROM case_vectors) AS total_indexed
FROM query_vectors q LEFT JOIN (knn k JOIN case_meta m USING (case_id)) ON q.query_id = k.query_id
GROUP BY q.query_id""",
)
def search_response(spark, sf_dir):
    """O-V7/O-V8/O-V9: neighbours joined to case metadata, one response per
    query (queries without hits kept), display fields, total indexed."""
    cases = views.case_vectors(spark, sf_dir)
    nb = ov.neighbour_display(ov.case_join(_knn(spark, sf_dir), _case_meta(spark, sf_dir)))
    total = cases.agg(F.count(F.lit(1)).alias("total_indexed"))
    n_indexed = total.first()[0]  # one number
    resp = ov.search_response(views.query_vectors(spark, sf_dir).select("query_id"), nb,
                              F.lit(n_indexed).cast("bigint"))
    agg = nb.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("similarity_percent"))).alias("top_percent"),
        F.max("is_filing").alias("any_filing"),
    )
    return (
        resp.join(agg, "query_id", "left")
        .withColumn("n_results", F.size("results").cast("bigint"))
        .withColumn("top_policy", F.get(F.col("results.policy_id"), 0))
        .withColumn("policies", F.nullif(F.array_join(F.col("results.policy_id"), ","), F.lit("")))
        .withColumn("any_filing", F.coalesce(F.col("any_filing"), F.lit(False)))
        .select("query_id", "n_results", "top_policy", "top_percent", "any_filing", "policies", "total_indexed")
    )


@register(
    "hash_embed",
    """WITH toks AS (
  SELECT doc_id, text, md5(tok) AS h FROM (
    SELECT doc_id, text, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS tok FROM documents)
  WHERE tok <> ''),
b AS (SELECT doc_id, CAST(CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % 384 AS INTEGER) AS bucket,
        sum(CASE WHEN CAST(('0x' || substr(h, 9, 1)) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS w
      FROM toks GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM b GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(count(*) FILTER (WHERE b.w <> 0 AND n.norm > 0), 0) AS BIGINT) AS nnz,
  round(coalesce(sum(CASE WHEN n.norm > 0 THEN (b.bucket + 1) * b.w / n.norm END), 0.0), 6) AS checksum
FROM documents d LEFT JOIN b USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id""",
)
def hash_embed(spark, sf_dir):
    """O-V1: hashing embedder over every document (384 buckets), summarised."""
    d = views.table(spark, sf_dir, "documents")
    e = ov.hash_embed(d, "doc_id", "text", 384)
    return e.select(
        "doc_id",
        F.size(F.filter("vector", lambda x: x != 0)).cast("bigint").alias("nnz"),
        F.round(F.aggregate(F.transform("vector", lambda x, i: (i + 1) * x), F.lit(0.0), lambda a, x: a + x), 6).alias(
            "checksum"
        ),
    )
