"""Consolidation and short-lived entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import tiers as T
from .base import NOW, ephemeral, query, tiered

_RATE = f"{scores.WEEK_RATE!r}::DOUBLE"
_DECAY = f"importance * (access_count + 1) * exp(-{_RATE} * greatest({NOW}::DOUBLE - last_accessed, 0))"


@query(
    "importance_score",
    r""", s AS (SELECT a.id, max(list_cosine_similarity(a.embedding, b.embedding)) AS top FROM v_tier a LEFT JOIN v_tier b ON b.tier = 'Working' AND b.id < a.id AND b.embedding IS NOT NULL WHERE a.embedding IS NOT NULL GROUP BY a.id)
 SELECT id, round(least(greatest(0.5::DOUBLE * least(greatest(1 - coalesce(top, 0), 0), 1) + 0.3::DOUBLE * CASE WHEN source = 'Correction' THEN 1 ELSE 0 END
   + 0.2::DOUBLE * least(len(list_filter(regexp_split_to_array(trim(chunk), '\s+'), lambda x: x <> '')) / 100.0::DOUBLE, 1), 0), 1), 6) AS importance FROM v_tier JOIN s USING (id)""",
    "v_memory v_tier",
)
def importance_score(spark: SparkSession, sf: str) -> DataFrame:
    """All rows against the working ones before them."""
    rows = tiered(spark, sf).where("embedding is not null")
    s = T.surprise(rows, rows.where("tier = 'Working'"))
    done = rows.join(s, "id").withColumn("importance", scores.importance(F.col("surprise"), F.col("source") == "Correction", F.col("chunk")))
    return done.select("id", F.round("importance", 6).alias("importance"))


@query("decay_score", f" SELECT id, round({_DECAY}, 6) AS decay FROM v_tier", "v_memory v_tier")
def decay_score(spark: SparkSession, sf: str) -> DataFrame:
    return T.decay(tiered(spark, sf), NOW).select("id", F.round("decay", 6).alias("decay"))


@query(
    "consolidate_cycle",
    f""", d AS (SELECT *, {_DECAY} AS decay FROM v_tier),
 w AS (SELECT * FROM d WHERE tier <> 'Working' OR id IN (SELECT id FROM d WHERE tier = 'Working' ORDER BY decay DESC, id DESC LIMIT 100)),
 p AS (SELECT * REPLACE (CASE WHEN tier = 'Working' AND importance > 0.6 THEN 'Episodic' ELSE tier END AS tier) FROM w),
 q AS (SELECT * REPLACE (CASE WHEN tier = 'Episodic' AND access_count > 10 THEN 'Semantic' ELSE tier END AS tier) FROM p)
 SELECT id, tier, round(decay, 6) AS decay FROM q WHERE tier <> 'Episodic' OR id IN (SELECT id FROM q WHERE tier = 'Episodic' ORDER BY decay DESC, id DESC LIMIT 150)""",
    "v_memory v_tier",
)
def consolidate_cycle(spark: SparkSession, sf: str) -> DataFrame:
    done = T.consolidate(tiered(spark, sf), NOW, T.Config(working_capacity=100, episodic_capacity=150))
    return done.select("id", "tier", F.round("decay", 6).alias("decay"))


@query("tier_stats", " SELECT tier, count(*) AS n, round(avg(importance), 6) AS avg_importance, sum(access_count) AS accesses, max(last_accessed) AS last FROM v_tier GROUP BY tier", "v_memory v_tier")
def tier_stats(spark: SparkSession, sf: str) -> DataFrame:
    return T.tier_stats(tiered(spark, sf)).withColumn("avg_importance", F.round("avg_importance", 6))


@query("eviction_order", f" SELECT id, tier, row_number() OVER (PARTITION BY tier ORDER BY round({_DECAY}, 9), id) AS evict_rank FROM v_tier", "v_memory v_tier")
def eviction_order(spark: SparkSession, sf: str) -> DataFrame:
    return T.evict_rank(T.decay(tiered(spark, sf), NOW).withColumn("decay", F.round("decay", 9))).select("id", "tier", "evict_rank")


_LIVE = f"(expires_at = 0 OR expires_at >= {NOW}::DOUBLE)"


@query("ephemeral_live", f" SELECT key, expires_at, round(CASE WHEN expires_at = 0 THEN -1 ELSE expires_at - {NOW}::DOUBLE END, 6) AS ttl FROM v_ephemeral WHERE {_LIVE}", "v_memory v_ephemeral")
def ephemeral_live(spark: SparkSession, sf: str) -> DataFrame:
    e = T.live(ephemeral(spark, sf), NOW)
    return e.select("key", "expires_at", F.round(F.when(F.col("expires_at") == 0, -1.0).otherwise(F.col("expires_at") - NOW), 6).alias("ttl"))


@query("ephemeral_evict", " SELECT key, access_count FROM v_ephemeral WHERE expires_at = 0 AND key <> (SELECT key FROM v_ephemeral WHERE expires_at = 0 ORDER BY access_count, last_accessed, key LIMIT 1)", "v_memory v_ephemeral")
def ephemeral_evict(spark: SparkSession, sf: str) -> DataFrame:
    return T.make_room(ephemeral(spark, sf).where("expires_at = 0"), NOW, 10).select("key", "access_count")


@query("ephemeral_purge", f" SELECT key FROM v_ephemeral WHERE {_LIVE}", "v_memory v_ephemeral")
def ephemeral_purge(spark: SparkSession, sf: str) -> DataFrame:
    return T.make_room(ephemeral(spark, sf), NOW, 10).select("key")


@query("ephemeral_promote", f" SELECT key, 'ephemeral::' || key AS source_channel, length(coalesce(text, '')) AS n_chars, coalesce(len(embedding), 64) AS dim, 1.0::DOUBLE AS activation FROM v_ephemeral WHERE {_LIVE} AND access_count >= 5", "v_memory v_ephemeral")
def ephemeral_promote(spark: SparkSession, sf: str) -> DataFrame:
    return T.promotable(ephemeral(spark, sf), NOW, 5, 64).select("key", "source_channel", F.length("chunk").alias("n_chars"), F.size("embedding").alias("dim"), "activation")


@query("ephemeral_stats", f" SELECT count(*) AS len, count(*) FILTER (WHERE {_LIVE}) AS total_entries, count(*) FILTER (WHERE {_LIVE} AND text IS NOT NULL) AS with_text, count(*) FILTER (WHERE {_LIVE} AND embedding IS NOT NULL) AS with_embedding, sum(access_count) FILTER (WHERE {_LIVE}) AS accesses FROM v_ephemeral", "v_memory v_ephemeral")
def ephemeral_stats(spark: SparkSession, sf: str) -> DataFrame:
    ok = (F.col("expires_at") == 0) | (F.col("expires_at") >= NOW)
    return ephemeral(spark, sf).agg(F.count("*").alias("len"), F.count_if(ok).alias("total_entries"), F.count_if(ok & F.col("text").isNotNull()).alias("with_text"), F.count_if(ok & F.col("embedding").isNotNull()).alias("with_embedding"), F.sum(F.when(ok, F.col("access_count"))).alias("accesses"))
