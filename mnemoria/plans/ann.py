"""Approximate search and multimodal records over the embeddings.

Lists and code words are trained on the rows themselves. Searches take every row whose id is divisible by 50 as a query, against all
rows, and read indexes that are written once: lists as folders, codes and vectors beside each other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ann as A
from .base import query, shared_folder
from .base import vectors as vector_rows
from .retrieval import probe

#: Lists, lists that a query looks into, steps of the fit.
K, PROBES, STEPS = 32, 20, 5
#: Slices of a vector, code words of each, candidates that are ranked exactly.
PARTS, CODES, CANDIDATES = 32, 16, 60

_BUILT: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, sf: str, what: str, make):  # noqa: ANN001, ANN202
    key = spark.sparkContext.applicationId, sf, what
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


def centroids(spark: SparkSession, sf: str) -> np.ndarray:
    return _once(spark, sf, "centroids", lambda: np.array(A.kmeans(vector_rows(spark, sf), K, STEPS)))


def books(spark: SparkSession, sf: str) -> np.ndarray:
    return _once(spark, sf, "books", lambda: A.pq_fit(vector_rows(spark, sf), PARTS, CODES, STEPS))


def _stored(spark: SparkSession, sf: str, what: str, make, by: str | None = None) -> DataFrame:  # noqa: ANN001
    def write() -> str:
        folder = f"{shared_folder(spark, 'index')}/{what}"
        rows = make()
        (rows.repartition(by).write.partitionBy(by) if by else rows.write).parquet(folder)
        return folder

    return spark.read.parquet(_once(spark, sf, what, write))


def lists(spark: SparkSession, sf: str) -> DataFrame:
    """All rows with their codes, in a folder for each list."""
    return _stored(spark, sf, "lists", lambda: A.pq_encode(A.assign(vector_rows(spark, sf), centroids(spark, sf)), books(spark, sf)), "cluster")


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return vector_rows(spark, sf).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _r6(found: DataFrame) -> DataFrame:
    return found.withColumn("score", F.round("score", 6))


def _ivf_sql() -> str:
    out = f", c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS c, v AS cv FROM v_vec QUALIFY c < {K})"
    for i in range(STEPS):
        out += f""", o{i} AS MATERIALIZED (SELECT vec_id, v, c FROM v_vec, c{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(v, cv), 12) DESC, c) = 1),
 c{i + 1} AS MATERIALIZED (SELECT c, list(m ORDER BY i) AS cv FROM (SELECT c, i, avg(v[i]) AS m FROM o{i}, (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i) GROUP BY c UNION ALL SELECT c, cv FROM c{i} WHERE c NOT IN (SELECT c FROM o{i}))"""
    return out + f""", cent AS MATERIALIZED (SELECT c, cv FROM c{STEPS}), own AS MATERIALIZED (SELECT vec_id, v, c AS cluster FROM v_vec, cent QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(v, cv), 12) DESC, c) = 1),
 ask AS MATERIALIZED (SELECT vec_id AS query_id, v AS q FROM v_vec WHERE vec_id % 50 = 0),
 near AS MATERIALIZED (SELECT query_id, q, c FROM ask, cent QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q, cv), 12) DESC, c) <= {PROBES})"""


def _pq_sql() -> str:
    w = 64 // PARTS
    mean = "[" + ", ".join(f"avg(s[{i + 1}])" for i in range(w)) + "]"
    out = f""", sl AS MATERIALIZED (SELECT vec_id, p, v[p * {w} + 1:(p + 1) * {w}] AS s FROM v_vec, (SELECT unnest(range({PARTS})) AS p)),
 b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS code, s AS w FROM sl QUALIFY code < {CODES})"""
    for i in range(STEPS + 1):
        out += f", e{i} AS MATERIALIZED (SELECT vec_id, p, s, code FROM sl JOIN b{i} USING (p) QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY round(pow(list_distance(s, w), 2), 12), code) = 1)"
        if i < STEPS:
            out += f", b{i + 1} AS MATERIALIZED (SELECT p, code, {mean} AS w FROM e{i} GROUP BY p, code UNION ALL SELECT p, code, w FROM b{i} ANTI JOIN e{i} USING (p, code))"
    return out + f""", tab AS MATERIALIZED (SELECT query_id, p, code, pow(list_distance(q[p * {w} + 1:(p + 1) * {w}], w), 2) AS d FROM b{STEPS}, (SELECT vec_id AS query_id, v AS q FROM v_vec WHERE vec_id % 50 = 0)),
 adc AS MATERIALIZED (SELECT query_id, vec_id, round(sum(d), 9) AS adc FROM e{STEPS} JOIN tab USING (p, code) GROUP BY query_id, vec_id)"""


_IVF, _PQ = _ivf_sql(), _pq_sql()
_BEST = " SELECT query_id, id, round(score, 6) AS score FROM ({}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10"
_EXACT = "SELECT c.query_id, c.vec_id AS id, list_cosine_similarity(a.v, b.v) AS score FROM cand c JOIN v_vec a ON a.vec_id = c.query_id JOIN v_vec b ON b.vec_id = c.vec_id"


@query("ivf_assign", _IVF + " SELECT vec_id, cluster FROM own", "v_vec")
def ivf_assign(spark: SparkSession, sf: str) -> DataFrame:
    return A.assign(vector_rows(spark, sf), centroids(spark, sf)).select("vec_id", "cluster")


@query("ivf_probe", _IVF + _BEST.format("SELECT query_id, vec_id AS id, list_cosine_similarity(v, q) AS score FROM near JOIN own ON cluster = c"), "v_vec")
def ivf_probe(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(A.search(lists(spark, sf), asked(spark, sf), 10, centroids(spark, sf), PROBES))


@query("ivf_balance", _IVF + " SELECT count(*) AS lists, max(n) AS largest, round(avg(n), 6) AS mean, max(n) <= 3 * avg(n) AS balanced FROM (SELECT cluster, count(*) AS n FROM own GROUP BY cluster)", "v_vec")
def ivf_balance(spark: SparkSession, sf: str) -> DataFrame:
    n = lists(spark, sf).groupBy("cluster").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("lists"), F.max("n").alias("largest"), F.round(F.avg("n"), 6).alias("mean"), (F.max("n") <= 3 * F.avg("n")).alias("balanced"))


#: Lists of two that a vector stands in need fewer probes.
_RAIRS_PROBES = 12


@query(
    "rairs_probe",
    _IVF.replace(f"<= {PROBES})", f"<= {_RAIRS_PROBES})") + """, mid AS MATERIALIZED (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(cv[i]) AS m FROM cent, (SELECT unnest(range(1, 65)) AS i) GROUP BY i)),
 air AS MATERIALIZED (SELECT o.vec_id, o.v, c, o.cluster <> c AS other, round(0.7::DOUBLE * list_cosine_similarity(o.v, cv)
   + 0.3::DOUBLE * CASE WHEN list_distance(o.v, cv) = 0 THEN 0 ELSE list_cosine_similarity([o.v[i] - cv[i] for i in range(1, 65)], [m[i] - o.v[i] for i in range(1, 65)]) END, 12) AS s FROM own o, cent, mid),
 two AS MATERIALIZED (SELECT vec_id, v, c AS cluster FROM air QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY other, s DESC, c) <= 2)""" + _BEST.format("SELECT DISTINCT query_id, vec_id AS id, list_cosine_similarity(v, q) AS score FROM near JOIN two ON cluster = c"),
    "v_vec",
)
def rairs_probe(spark: SparkSession, sf: str) -> DataFrame:
    c = centroids(spark, sf)
    stored = _stored(spark, sf, "rairs", lambda: A.rairs_assign(vector_rows(spark, sf), c), "cluster")
    return _r6(A.search(stored, asked(spark, sf), 10, c, _RAIRS_PROBES, copies=2))


@query("pq_encode", _PQ + f" SELECT vec_id, string_agg(code, '-' ORDER BY p) AS codes FROM e{STEPS} GROUP BY vec_id", "v_vec")
def pq_encode(spark: SparkSession, sf: str) -> DataFrame:
    return A.pq_encode(vector_rows(spark, sf), books(spark, sf)).select("vec_id", F.array_join(F.col("codes").cast("array<string>"), "-").alias("codes"))


@query("pq_adc_rerank", _PQ + f", cand AS (SELECT query_id, vec_id FROM adc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY adc, vec_id) <= {CANDIDATES})" + _BEST.format(_EXACT), "v_vec")
def pq_adc_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(A.search(lists(spark, sf), asked(spark, sf), 10, books=books(spark, sf), candidates=CANDIDATES))


@query("ivfpq_search", _IVF + _PQ + f", cand AS (SELECT query_id, vec_id FROM adc JOIN own USING (vec_id) JOIN near USING (query_id) WHERE cluster = c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY adc, vec_id) <= {CANDIDATES})" + _BEST.format(_EXACT), "v_vec")
def ivfpq_search(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(A.search(lists(spark, sf), asked(spark, sf), 10, centroids(spark, sf), PROBES, books(spark, sf), CANDIDATES))


@query("kmeans_train", _IVF + " SELECT cluster, count(*) AS n, min(vec_id) AS first_id FROM own GROUP BY cluster", "v_vec")
def kmeans_train(spark: SparkSession, sf: str) -> DataFrame:
    """Trained centroids, and what falls to each."""
    v = vector_rows(spark, sf)
    return A.assign(v, A.kmeans(v, K, STEPS)).groupBy("cluster").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))


@query("hnsw_topk")
def hnsw_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The best 10 for every row whose id is divisible by 50, from stored graphs."""
    folder = _once(spark, sf, "hnsw", lambda: _write_graphs(spark, sf))
    return _r6(A.hnsw_search(spark.read.parquet(folder), asked(spark, sf), 10))


def _write_graphs(spark: SparkSession, sf: str) -> str:
    folder = shared_folder(spark, "index") + "/hnsw"
    A.hnsw_build(vector_rows(spark, sf), folder)
    return folder


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of up to two embeddings, of modalities by label."""
    names = F.array(*map(F.lit, ["Text", "Image", "Audio", "Video", "Code"]))
    e = F.struct(F.element_at(names, (F.col("label") % 5 + 1).cast("int")).alias("modality"), "embedding")
    return vector_rows(spark, sf).groupBy(F.floor(F.col("vec_id") / 2).cast("long").alias("id")).agg(F.collect_list(e).alias("embeddings"))


_REC = ", rec AS (SELECT CAST(floor(vec_id / 2) AS BIGINT) AS id, ['Text', 'Image', 'Audio', 'Video', 'Code'][label % 5 + 1] AS modality, v FROM v_vec), qv AS (SELECT v AS q FROM v_vec WHERE vec_id = 1)"


@query("crossmodal_topk", _REC + " SELECT id, round(max(list_cosine_similarity(v, q)), 6) AS score FROM rec, qv GROUP BY id ORDER BY max(list_cosine_similarity(v, q)) DESC, id LIMIT 15", "v_vec")
def crossmodal_topk(spark: SparkSession, sf: str) -> DataFrame:
    return A.by_modality(records(spark, sf), probe(spark, sf), None, 15).withColumn("score", F.round("score", 6))


@query("modality_topk", _REC + " SELECT id, round(max(list_cosine_similarity(v, q)), 6) AS score FROM rec, qv WHERE modality = 'Image' GROUP BY id ORDER BY max(list_cosine_similarity(v, q)) DESC, id LIMIT 15", "v_vec")
def modality_topk(spark: SparkSession, sf: str) -> DataFrame:
    return A.by_modality(records(spark, sf), probe(spark, sf), "Image", 15).withColumn("score", F.round("score", 6))


@query("modality_counts", _REC + " SELECT modality, count(*) AS n, count(DISTINCT id) AS n_records FROM rec GROUP BY modality", "v_vec")
def modality_counts(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("id", F.explode("embeddings").alias("e")).groupBy(F.col("e.modality").alias("modality")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_records"))


@query("strategy_choice", " SELECT n, CASE WHEN n > 500000 THEN 'ivf_pq' WHEN n > 50000 THEN 'blas' WHEN n > 10000 THEN 'blas' WHEN n >= 1000 THEN 'blas' ELSE 'scalar' END AS with_blas, CASE WHEN n > 50000 THEN 'ivf_pq' WHEN n > 10000 THEN 'parallel' WHEN n >= 1000 THEN 'simd' ELSE 'scalar' END AS without FROM (SELECT unnest([10, 999, 1000, 10000, 10001, 50000, 50001, 500000, 500001]) AS n)")
def strategy_choice(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.createDataFrame([(x,) for x in (10, 999, 1000, 10000, 10001, 50000, 50001, 500000, 500001)], "n long")
    return n.select("n", A.strategy(F.col("n")).alias("with_blas"), A.strategy(F.col("n"), blas=False).alias("without"))
