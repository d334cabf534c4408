"""Search, fusion and re-ranking over the memory view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores, vectors
from ..operators import retrieval as R
from ..operators.store import numbered
from .base import NOW, ephemeral, events, memory, query, search_index, table
from .base import vectors as vector_rows

QUERY = "Licensed under the the license"
QUERY_VECTOR = 1  # the vector with this id asks


def probe(spark: SparkSession, sf: str, vec_id: int = QUERY_VECTOR) -> list[float]:
    """The embedding of one row, by id."""
    return [float(x) for x in table(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]]


def r6(*names: str):  # noqa: ANN201
    return {n: F.round(n, 6) for n in names}


_TOK = r""", tok AS (SELECT mem_id, list_filter(regexp_split_to_array(lower(chunk), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS toks FROM v_memory WHERE tombstone = 0),
 st AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM tok),
 q AS (SELECT unnest(['licensed', 'under', 'the', 'the', 'license']) AS term),
 qd AS (SELECT term, count(*) AS times FROM q GROUP BY term),
 tf AS (SELECT mem_id, len(toks) AS dl, term, times, len(list_filter(toks, lambda x: x = term)) AS tf FROM tok, qd),
 df AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY term),
 kw AS (SELECT mem_id AS id, sum(times * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
   FROM tf JOIN df USING (term), st WHERE tf > 0 GROUP BY mem_id)"""
_VEC = """, qv AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 1),
 vec AS (SELECT mem_id AS id, list_cosine_similarity(embedding, q) AS score FROM v_memory, qv WHERE tombstone = 0 AND embedding IS NOT NULL)"""
_FUSED = """, fused AS (SELECT coalesce(v.id, k.id) AS id, 0.7::DOUBLE * coalesce(v.s, 0) + 0.3::DOUBLE * coalesce(k.s, 0) AS score FROM
   (SELECT id, CASE WHEN hi = lo THEN 0 ELSE (score - lo) / (hi - lo) END AS s FROM vec, (SELECT min(score) AS lo, max(score) AS hi FROM vec)) v FULL OUTER JOIN
   (SELECT id, CASE WHEN hi = lo THEN 0 ELSE (score - lo) / (hi - lo) END AS s FROM kw, (SELECT min(score) AS lo, max(score) AS hi FROM kw)) k ON v.id = k.id)"""
_POOLED = _VEC.replace("embedding IS NOT NULL)", "embedding IS NOT NULL ORDER BY score DESC, id LIMIT 240)")
_RERANK = f"0.3::DOUBLE * pow(2.0::DOUBLE, -greatest({NOW}::DOUBLE - timestamp, 0) / 86400.0::DOUBLE) + 0.2::DOUBLE * CASE source_channel WHEN 'user_correction' THEN 1.0 WHEN 'conversation' THEN 0.7 WHEN 'system' THEN 0.4 ELSE 0.2 END + 0.5::DOUBLE * least(greatest(activation, 0), 1)"


@query("hybrid_weighted_topk", _TOK + _VEC + _FUSED + " SELECT id, round(score, 6) AS score FROM fused ORDER BY round(fused.score, 9) DESC, id LIMIT 10", "v_memory")
def hybrid_weighted_topk(spark: SparkSession, sf: str) -> DataFrame:
    return R.top(search_index(spark, sf).fused(QUERY, probe(spark, sf)).withColumn("score", F.round("score", 9)), 10).withColumns(r6("score"))


@query("bm25_topk", _TOK + " SELECT id, round(score, 6) AS score FROM kw ORDER BY round(kw.score, 9) DESC, id LIMIT 20", "v_memory")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return R.top(search_index(spark, sf).bm25(QUERY).withColumn("score", F.round("score", 9)), 20).withColumns(r6("score"))


@query("bm25_stats", _TOK + " SELECT n_docs, round(avgdl, 6) AS avgdl, (SELECT df FROM df WHERE term = 'licensed') AS df_0, (SELECT df FROM df WHERE term = 'under') AS df_1, (SELECT df FROM df WHERE term = 'the') AS df_2, (SELECT df FROM df WHERE term = 'license') AS df_3 FROM st", "v_memory")
def bm25_stats(spark: SparkSession, sf: str) -> DataFrame:
    index = search_index(spark, sf)
    df = index.frequencies(list(dict.fromkeys(R.query_terms(QUERY))))
    own = {f"df_{i}": F.lit(n).cast("long") for i, n in enumerate(df.values())}
    return spark.range(1).select(F.lit(index.n_docs).cast("long").alias("n_docs"), F.round(F.lit(index.avgdl), 6).alias("avgdl"), *[v.alias(k) for k, v in own.items()])


@query(
    "bm25_batch",
    r""", tok AS (SELECT mem_id, list_filter(regexp_split_to_array(lower(chunk), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS toks FROM v_memory WHERE tombstone = 0),
 st AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM tok), post AS (SELECT mem_id, dl, term, count(*) AS tf FROM (SELECT mem_id, len(toks) AS dl, unnest(toks) AS term FROM tok) GROUP BY ALL),
 qd AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY ALL),
 df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
 s AS (SELECT query_id, mem_id AS id, sum(times * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM post JOIN qd USING (term) JOIN df USING (term), st GROUP BY query_id, mem_id)
 SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= 5""",
    "v_memory",
)
def bm25_batch(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search_index(spark, sf).bm25_batch(asked, 5, 9).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("cosine_topk", _VEC + " SELECT id, round(score, 6) AS score FROM vec ORDER BY vec.score DESC, id LIMIT 20", "v_memory")
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return R.top(R.cosine_scores(memory(spark, sf), probe(spark, sf)), 20).withColumns(r6("score"))


@query("l2_topk", " , qv AS (SELECT v AS q FROM v_vec WHERE vec_id = 1) SELECT vec_id AS id, round(list_distance(v, q), 6) AS distance FROM v_vec, qv ORDER BY list_distance(v, q), vec_id LIMIT 20", "v_vec")
def l2_topk(spark: SparkSession, sf: str) -> DataFrame:
    return R.l2_scores(vector_rows(spark, sf), probe(spark, sf), "vec_id").orderBy("distance", "id").limit(20).withColumns(r6("distance"))


@query(
    "cosine_batch",
    """, s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.v, b.v) AS score FROM v_vec a, v_vec b WHERE a.vec_id % 50 = 0)
 SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""",
    "v_vec",
)
def cosine_batch(spark: SparkSession, sf: str) -> DataFrame:
    v = vector_rows(spark, sf)
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.batch_topk(v, asked, 5).withColumns(r6("score"))


@query("vector_norms", " SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(list_dot_product(v, q), 6) AS dot FROM v_vec, (SELECT v AS q FROM v_vec WHERE vec_id = 1)", "v_vec")
def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    q = vectors.literal(probe(spark, sf))
    return vector_rows(spark, sf).select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.round(vectors.dot(F.col("embedding"), q), 6).alias("dot"))


@query(
    "rrf_topk",
    _TOK + _VEC + """, r AS (SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY round(score, 9) DESC, id)) AS s FROM vec UNION ALL SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY round(score, 9) DESC, id)) FROM kw)
 SELECT id, round(sum(s), 6) AS score FROM r GROUP BY id ORDER BY round(sum(s), 12) DESC, id LIMIT 20""",
    "v_memory",
)
def rrf_topk(spark: SparkSession, sf: str) -> DataFrame:
    index = search_index(spark, sf)
    lists = [x.select("id", F.round("score", 9).alias("score")) for x in (index.cosine(probe(spark, sf)), index.bm25(QUERY))]
    return R.fuse_rrf(lists).orderBy(F.round("score", 12).desc(), "id").limit(20).withColumns(r6("score"))


@query("rerank_multifactor", f" SELECT mem_id AS id, round({_RERANK}, 6) AS score FROM v_memory WHERE tombstone = 0 ORDER BY round({_RERANK}, 9) DESC, mem_id LIMIT 50", "v_memory")
def rerank_multifactor(spark: SparkSession, sf: str) -> DataFrame:
    m = R.active(memory(spark, sf)).withColumnRenamed("mem_id", "id")
    done = R.rerank(m, NOW).select("id", F.round("score", 9).alias("score"))
    return R.top(done, 50).withColumns(r6("score"))


@query("confidence_filter", _VEC + ", b AS (SELECT max(score) AS best FROM vec) SELECT id, round(score, 6) AS score FROM vec, b WHERE best >= 0.1 AND score >= 0.1 AND best - score <= 0.8 ORDER BY vec.score DESC, id LIMIT 10", "v_memory")
def confidence_filter(spark: SparkSession, sf: str) -> DataFrame:
    return R.reject(R.cosine_scores(memory(spark, sf), probe(spark, sf)), max_gap=0.8).withColumns(r6("score"))


@query(
    "backend_search",
    _TOK + _POOLED + _FUSED + f""", cand AS (SELECT id FROM fused ORDER BY round(score, 9) DESC, id LIMIT 30),
 rr AS (SELECT id, {_RERANK} AS score FROM cand JOIN v_memory ON id = mem_id)
 SELECT id, round(score, 6) AS score FROM rr, (SELECT max(score) AS best FROM rr) WHERE best >= 0.1 AND score >= 0.1 AND best - score <= 0.5 ORDER BY round(rr.score, 9) DESC, id LIMIT 10""",
    "v_memory",
)
def backend_search(spark: SparkSession, sf: str) -> DataFrame:
    return search_index(spark, sf).search(QUERY, probe(spark, sf), 10, NOW).select("id", F.round("score", 6).alias("score"))


@query(
    "unified_search",
    _TOK + """, e AS (SELECT 'k' || mem_id AS key, (CASE WHEN contains(lower(text), 'licensed') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'under') THEN 1 ELSE 0 END + 2 * CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'license') THEN 1 ELSE 0 END) * 1.2::DOUBLE AS score
   FROM v_ephemeral WHERE text IS NOT NULL AND (expires_at = 0 OR expires_at >= """ + f"{NOW}::DOUBLE" + """))
 SELECT origin, key, round(score, 6) AS score FROM (SELECT 'memory' AS origin, 'm' || id AS key, score FROM kw UNION ALL SELECT 'ephemeral', key, score FROM e WHERE score > 0) ORDER BY round(score, 9) DESC, key LIMIT 20""",
    "v_memory v_ephemeral",
)
def unified_search(spark: SparkSession, sf: str) -> DataFrame:
    """Memory and live short-lived entries in one list; the latter count a fifth more."""
    kept = search_index(spark, sf).bm25(QUERY).select(F.lit("memory").alias("origin"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("key"), "score")
    live = ephemeral(spark, sf).where((F.col("expires_at") == 0) | (F.col("expires_at") >= NOW))
    brief = R.expected_term_hits(live, QUERY).select(F.lit("ephemeral").alias("origin"), "key", (F.col("score") * 1.2).alias("score"))
    both = kept.unionByName(brief).withColumn("score", F.round("score", 9))
    return both.orderBy(F.desc("score"), "key").limit(20).withColumns(r6("score"))


@query(
    "ephemeral_text_search",
    """ SELECT key, score FROM (SELECT key, mem_id, CAST(CASE WHEN contains(lower(text), 'licensed') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'under') THEN 1 ELSE 0 END + 2 * CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'license') THEN 1 ELSE 0 END AS DOUBLE) AS score
 FROM v_ephemeral WHERE text IS NOT NULL) WHERE score > 0 ORDER BY score DESC, mem_id LIMIT 20""",
    "v_memory v_ephemeral",
)
def ephemeral_text_search(spark: SparkSession, sf: str) -> DataFrame:
    return R.expected_term_hits(ephemeral(spark, sf), QUERY).orderBy(F.desc("score"), "mem_id").limit(20).select("key", "score")


@query(
    "ephemeral_vec_search",
    ", qv AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 1), s AS (SELECT key, mem_id, list_cosine_similarity(embedding, q) AS score FROM v_ephemeral, qv WHERE embedding IS NOT NULL AND list_dot_product(embedding, embedding) > 0) SELECT key, round(score, 6) AS score FROM s ORDER BY s.score DESC, mem_id LIMIT 20",
    "v_memory v_ephemeral",
)
def ephemeral_vec_search(spark: SparkSession, sf: str) -> DataFrame:
    """Entries without a direction are left out, not scored 0."""
    e = ephemeral(spark, sf).where(F.col("embedding").isNotNull() & (vectors.norm(F.col("embedding")) > 0))
    return e.select("key", "mem_id", vectors.cosine(F.col("embedding"), vectors.literal(probe(spark, sf))).alias("score")).orderBy(F.desc("score"), "mem_id").limit(20).select("key", F.round("score", 6).alias("score"))


_T0 = 1_705_000_000.0


@query(
    "temporal_boost",
    f""" SELECT event_id, round(pow(2.0::DOUBLE, -greatest({_T0 + 1e6}::DOUBLE - timestamp, 0) / 86400.0::DOUBLE), 6) AS latest,
 round(1 - pow(2.0::DOUBLE, -greatest({_T0 + 1e6}::DOUBLE - timestamp, 0) / 86400.0::DOUBLE), 6) AS earliest,
 round(exp(-0.5::DOUBLE * ((timestamp - {_T0}::DOUBLE) / 86400.0::DOUBLE) * ((timestamp - {_T0}::DOUBLE) / 86400.0::DOUBLE)), 6) AS around,
 round(exp(-greatest({_T0}::DOUBLE - timestamp, timestamp - {_T0 + 2e5}::DOUBLE, 0) / 86400.0::DOUBLE), 6) AS between_ FROM v_event""",
    "v_event",
)
def temporal_boost(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("timestamp")
    kinds = {"latest": (), "earliest": (), "around": (_T0,), "between": (_T0, _T0 + 2e5)}
    return events(spark, sf).select("event_id", *[F.round(scores.temporal_boost(ts, k, _T0 + 1e6, *a), 6).alias("between_" if k == "between" else k) for k, a in kinds.items()])


@query(
    "eval_hit_mrr",
    """, s AS (SELECT a.vec_id AS query_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.vec_id) AS rank, a.label = b.label AS good FROM v_vec a, v_vec b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
 f AS (SELECT query_id, min(rank) FILTER (WHERE good AND rank <= 20) AS rank FROM s GROUP BY query_id)
 SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hit_10, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM f""",
    "v_vec",
)
def eval_hit_mrr(spark: SparkSession, sf: str) -> DataFrame:
    v = vector_rows(spark, sf)
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("want"))
    found = R.batch_topk(v, asked.select("query_id", "embedding"), 21).where("id <> query_id")
    labelled = found.join(v.select(F.col("vec_id").alias("id"), "label"), "id").join(asked.select("query_id", "want"), "query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    first = labelled.withColumn("rank", place).groupBy("query_id").agg(F.min(F.when((F.col("label") == F.col("want")) & (F.col("rank") <= 20), F.col("rank"))).alias("rank"))
    return R.evaluate(first).withColumns(r6("hit_1", "hit_5", "hit_10", "mrr"))


@query(
    "latency_percentiles",
    " SELECT event_type, count(*) AS n, list_sort(list(value))[CAST(floor(count(*) * 0.50) AS BIGINT) + 1] AS p50, list_sort(list(value))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] AS p95, list_sort(list(value))[CAST(floor(count(*) * 0.99) AS BIGINT) + 1] AS p99 FROM v_event GROUP BY event_type",
    "v_event",
)
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles by place in the sorted list. All rows are numbered by ranges of type and value, so no type is sorted in one task."""
    e = events(spark, sf).where("event_type is not null").select("event_type", "value")
    counts = e.groupBy("event_type").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("event_type").rowsBetween(Window.unboundedPreceding, -1))  # a row for each type
    sizes = counts.withColumn("first", F.coalesce(before, F.lit(0)))
    named = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    j = numbered(e, ["event_type", "value"], "nth").join(sizes, "event_type").withColumn("at", F.col("nth") - F.col("first"))
    place = lambda p: F.floor(F.col("n") * p)
    hit = j.where((F.col("at") == place(0.5)) | (F.col("at") == place(0.95)) | (F.col("at") == place(0.99)))
    return hit.groupBy("event_type").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("at") == place(p), F.col("value"))).alias(k) for k, p in named.items()])


@query("footprint", " SELECT source_channel, count(*) AS n, sum(length(encode(chunk))) AS text_bytes, sum(coalesce(len(embedding), 0) * 4) AS vector_bytes, round((sum(length(encode(chunk))) + sum(coalesce(len(embedding), 0) * 4)) / count(*)::DOUBLE, 6) AS bytes_per_record FROM v_memory GROUP BY source_channel".replace("length(encode(chunk))", "octet_length(encode(chunk))"), "v_memory")
def footprint(spark: SparkSession, sf: str) -> DataFrame:
    m = memory(spark, sf)
    t, v = F.sum(F.octet_length("chunk")), F.sum(F.coalesce(F.greatest(F.size("embedding"), F.lit(0)), F.lit(0)) * 4)
    return m.groupBy("source_channel").agg(F.count("*").alias("n"), t.alias("text_bytes"), v.alias("vector_bytes"), F.round((t + v) / F.count("*"), 6).alias("bytes_per_record"))
