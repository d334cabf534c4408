"""Lifecycle and migration of the memory table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store as S
from .base import NOW, entities, exchanges, memory, query, shared_folder, table


@query(
    "upsert_by_tag",
    """, new AS (SELECT 'en' AS tags, 'new en' AS chunk UNION ALL SELECT 'xx', 'new xx' UNION ALL SELECT 'yy', 'new yy'),
 first AS (SELECT tags, min(mem_id) AS mem_id FROM v_memory WHERE tombstone = 0 GROUP BY tags)
 SELECT m.mem_id, md5(coalesce(n.chunk, m.chunk)) AS digest, m.tags, round(CASE WHEN n.tags IS NULL THEN m.activation ELSE 1.0 END, 6) AS activation FROM v_memory m LEFT JOIN first f ON f.mem_id = m.mem_id LEFT JOIN new n ON n.tags = f.tags
 UNION ALL SELECT (SELECT max(mem_id) FROM v_memory) + row_number() OVER (ORDER BY tags), md5(chunk), tags, 1.0 FROM new WHERE tags NOT IN (SELECT tags FROM first)""",
    "v_memory",
)
def upsert_by_tag(spark: SparkSession, sf: str) -> DataFrame:
    m = memory(spark, sf)
    new = spark.createDataFrame([("en", "new en"), ("xx", "new xx"), ("yy", "new yy")], "tags string, chunk string")
    return S.upsert(m, new, "tags", ["chunk"]).select("mem_id", F.md5("chunk").alias("digest"), "tags", F.round("activation", 6).alias("activation"))


@query("tombstone_compact", " SELECT row_number() OVER (ORDER BY mem_id) - 1 AS mem_id, mem_id AS old_id FROM v_memory WHERE tombstone = 0", "v_memory")
def tombstone_compact(spark: SparkSession, sf: str) -> DataFrame:
    return S.compact(memory(spark, sf)).select("mem_id", "old_id")


@query("compaction_due", " SELECT round(avg(tombstone), 6) AS fraction, avg(tombstone) > 0.3 AS compact FROM v_memory", "v_memory")
def compaction_due(spark: SparkSession, sf: str) -> DataFrame:
    return S.needs_compaction(memory(spark, sf)).withColumn("fraction", F.round("fraction", 6))


@query(
    "wal_replay",
    """ SELECT m.mem_id, md5(m.chunk) AS digest, CASE WHEN m.mem_id IN (SELECT item_id * 3 FROM benchmark) THEN 1 ELSE tombstone END AS tombstone FROM v_memory m
 UNION ALL SELECT (SELECT max(mem_id) FROM v_memory) + row_number() OVER (ORDER BY item_id), md5(text), 0 FROM benchmark""",
    "v_memory",
)
def wal_replay(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark")
    saves = b.select((F.col("item_id") * 2).alias("seq"), F.lit("save").alias("op"), F.lit(None).cast("long").alias("mem_id"), F.col("text").alias("chunk"))
    gone = b.select((F.col("item_id") * 2 + 1).alias("seq"), F.lit("tombstone").alias("op"), (F.col("item_id") * 3).alias("mem_id"), F.lit(None).cast("string").alias("chunk"))
    return S.replay(memory(spark, sf), saves.unionByName(gone)).select("mem_id", F.md5("chunk").alias("digest"), "tombstone")


@query("hebbian_boost", " SELECT mem_id, round(activation + CASE WHEN mem_id IN (SELECT item_id FROM benchmark) THEN 0.15 ELSE 0 END, 6) AS activation FROM v_memory", "v_memory")
def hebbian_boost(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"))
    return S.boost(memory(spark, sf), hits).select("mem_id", F.round("activation", 6).alias("activation"))


@query("decay_tick", " SELECT mem_id, round(activation * 0.98, 6) AS activation FROM v_memory", "v_memory")
def decay_tick(spark: SparkSession, sf: str) -> DataFrame:
    return S.tick(memory(spark, sf)).select("mem_id", F.round("activation", 6).alias("activation"))


@query("store_stats", " SELECT count(*) AS n, count(*) FILTER (WHERE tombstone = 0) AS n_active, count(*) FILTER (WHERE tombstone = 0 AND len(embedding) > 0) AS n_embedded, max(timestamp) FILTER (WHERE tombstone = 0) AS last, count(DISTINCT source_channel) FILTER (WHERE tombstone = 0) AS n_channels FROM v_memory", "v_memory")
def store_stats(spark: SparkSession, sf: str) -> DataFrame:
    return S.stats(memory(spark, sf))


@query("store_delete", " SELECT mem_id, CASE WHEN mem_id % 7 = 0 THEN 1 ELSE tombstone END AS tombstone FROM v_memory", "v_memory")
def store_delete(spark: SparkSession, sf: str) -> DataFrame:
    m = memory(spark, sf)
    return S.delete(m, m.where("mem_id % 7 = 0").select("mem_id")).select("mem_id", "tombstone")


@query("migrate_incremental", " SELECT mem_id, md5(chunk) AS digest FROM v_memory WHERE mem_id < 100 OR tombstone = 0", "v_memory")
def migrate_incremental(spark: SparkSession, sf: str) -> DataFrame:
    m = memory(spark, sf)
    return S.migrate(m.where("mem_id < 100"), m, "mem_id").select("mem_id", F.md5("chunk").alias("digest"))


@query("migrate_counts", " SELECT 'memory' AS source, count(*) AS n FROM v_memory WHERE tombstone = 0 UNION ALL SELECT 'relations', count(*) FROM v_edge UNION ALL SELECT 'entities', count(*) FROM v_entity", "v_memory v_entity v_edge")
def migrate_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The dry run: rows that each table would move."""
    from .base import edges, entities

    named = {"memory": memory(spark, sf).where("tombstone = 0"), "relations": edges(spark, sf), "entities": entities(spark, sf)}
    out = None
    for k, df in named.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(k).alias("source"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "migrate_validate",
    """ SELECT mem_id AS id, CASE WHEN mem_id % 11 = 0 THEN 'missing in target' WHEN mem_id % 13 = 0 THEN 'chunk differs' ELSE 'embedding differs' END AS problem
 FROM v_memory WHERE mem_id % 11 = 0 OR mem_id % 13 = 0 OR (mem_id % 17 = 0 AND embedding IS NOT NULL)""",
    "v_memory",
)
def migrate_validate(spark: SparkSession, sf: str) -> DataFrame:
    m = memory(spark, sf)
    moved = m.where("mem_id % 11 <> 0").withColumns({"chunk": F.when(F.col("mem_id") % 13 == 0, F.concat("chunk", F.lit("!"))).otherwise(F.col("chunk")), "embedding": F.when(F.col("mem_id") % 17 == 0, F.transform("embedding", lambda x: x + 0.01)).otherwise(F.transform("embedding", lambda x: x + 0.00001))})
    return S.validate(m, moved, "mem_id", "embedding", ["chunk"])


@query("store_delete_compact", " SELECT row_number() OVER (ORDER BY mem_id) - 1 AS mem_id, mem_id AS old_id FROM v_memory WHERE tombstone = 0 AND mem_id % 3 <> 0", "v_memory")
def store_delete_compact(spark: SparkSession, sf: str) -> DataFrame:
    """So much is deleted that the table is compacted at once."""
    m = memory(spark, sf)
    return S.delete_and_compact(m, m.where("mem_id % 3 = 0").select("mem_id")).select("mem_id", "old_id")


@query("store_compaction", " SELECT row_number() OVER (ORDER BY mem_id) - 1 AS mem_id, mem_id AS old_id, round(activation * 0.98, 6) AS activation FROM v_memory WHERE tombstone = 0", "v_memory")
def store_compaction(spark: SparkSession, sf: str) -> DataFrame:
    """Decay, compaction and a flush; what is read back from the store."""
    folder = shared_folder(spark, "store")
    S.flush(S.run_compaction(memory(spark, sf)).select("mem_id", "old_id", F.round("activation", 6).alias("activation")), folder)
    return S.current(spark, folder)


@query(
    "store_consolidation",
    """, a AS (SELECT mem_id AS id, activation AS importance FROM v_memory WHERE tombstone = 0), w AS (SELECT * FROM a ORDER BY importance DESC, id DESC LIMIT 100)
 SELECT (SELECT count(*) FROM w WHERE importance <= 0.6) AS working, (SELECT count(*) FROM w WHERE importance > 0.6) AS episodic, 0 AS semantic, (SELECT count(*) FROM a) AS total, (SELECT count(*) FROM a) - (SELECT count(*) FROM w) AS evicted""",
    "v_memory",
)
def store_consolidation(spark: SparkSession, sf: str) -> DataFrame:
    return S.run_consolidation(memory(spark, sf), NOW)


@query("store_snapshot", " SELECT mem_id, md5(chunk) AS digest, tombstone FROM v_memory WHERE mem_id % 2 = 0", "v_memory")
def store_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Two flushes and a snapshot of the second."""
    folder = shared_folder(spark, "store")
    m = memory(spark, sf).select("mem_id", F.md5("chunk").alias("digest"), "tombstone")
    S.flush(m.where("mem_id < 10"), folder)
    S.flush(m.where("mem_id % 2 = 0"), folder)
    return S.snapshot(spark, folder, f"{folder}/snapshot")


def _record_sql() -> str:
    from .strategy import _GATED

    return _GATED + """ SELECT mem_id, md5(chunk) AS digest, source_channel FROM v_memory
 UNION ALL SELECT (SELECT max(mem_id) FROM v_memory) + row_number() OVER (ORDER BY conv_id, turn_number), md5(user_turn || chr(10) || '---' || chr(10) || agent_turn), 'exchange' FROM ok"""


@query("record_exchange", _record_sql(), "v_memory v_exchange")
def record_exchange(spark: SparkSession, sf: str) -> DataFrame:
    """Every exchange through the gate into the memory table."""
    from ..operators.strategy import save_every

    return S.record(memory(spark, sf), save_every(exchanges(spark, sf)), ["conv_id", "turn_number"]).select("mem_id", F.md5("chunk").alias("digest"), "source_channel")


@query(
    "entity_store",
    """, f AS (SELECT id AS seq, substr(name, 1, length(name) - 1) || 'x' AS text FROM v_entity WHERE entity_type = 'nation' UNION ALL SELECT id + 5000, 'Old Planet ' || name FROM v_entity WHERE entity_type = 'region' UNION ALL SELECT id + 6000, 'OLD PLANET ' || name FROM v_entity WHERE entity_type = 'region'),
 near AS (SELECT text, e.id FROM (SELECT DISTINCT text FROM f) JOIN v_entity e ON abs(length(text) - length(e.name)) <= 1 AND levenshtein(lower(text), lower(e.name)) <= 1 QUALIFY row_number() OVER (PARTITION BY text ORDER BY levenshtein(lower(text), lower(e.name)), e.id) = 1),
 new AS (SELECT low, (SELECT max(id) FROM v_entity) + row_number() OVER (ORDER BY first) AS id FROM (SELECT lower(text) AS low, min(seq) AS first FROM f WHERE text NOT IN (SELECT text FROM near) GROUP BY 1))
 SELECT seq, f.text, coalesce(near.id, new.id) AS id, near.id IS NULL AS created FROM f LEFT JOIN near ON near.text = f.text LEFT JOIN new ON new.low = lower(f.text)""",
    "v_entity",
)
def entity_store(spark: SparkSession, sf: str) -> DataFrame:
    """Found names become entities that are there, or new ones."""
    from ..operators import graph as G

    e = entities(spark, sf)
    near = e.where("entity_type = 'nation'").select(F.col("id").alias("seq"), F.expr("concat(substring(name, 1, length(name) - 1), 'x')").alias("text"))
    new = e.where("entity_type = 'region'").select(F.explode(F.array(F.struct((F.col("id") + 5000).alias("seq"), F.concat(F.lit("Old Planet "), "name").alias("text")), F.struct((F.col("id") + 6000).alias("seq"), F.concat(F.lit("OLD PLANET "), "name").alias("text")))).alias("x")).select("x.*")
    found, _ = G.resolve_or_create(near.unionByName(new).withColumn("type", F.lit("location")), e)
    return found.select("seq", "text", "id", "created")


_PROV = ", p AS (SELECT mem_id AS record_id, source_channel AS source, mem_id % 4 = 0 OR mem_id IN (SELECT item_id FROM benchmark) AS verified FROM v_memory)"


@query("provenance_unverified", _PROV + " SELECT record_id, source FROM p WHERE NOT verified AND source IN ('conversation', 'system')", "v_memory")
def provenance_unverified(spark: SparkSession, sf: str) -> DataFrame:
    """Records of two sources that nobody has verified, after those of a list were."""
    p = memory(spark, sf).select(F.col("mem_id").alias("record_id"), F.col("source_channel").alias("source"), (F.col("mem_id") % 4 == 0).alias("verified"))
    p = S.mark_verified(p, table(spark, sf, "benchmark").select(F.col("item_id").alias("record_id")))
    return p.where(~F.col("verified") & F.col("source").isin("conversation", "system")).select("record_id", "source")


@query("point_lookup", " SELECT item_id AS mem_id, md5(chunk) AS digest FROM benchmark LEFT JOIN v_memory ON mem_id = item_id", "v_memory")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by id, in answer to each id asked for."""
    ids = table(spark, sf, "benchmark").select(F.col("item_id").alias("mem_id"))
    return ids.join(memory(spark, sf).select("mem_id", F.md5("chunk").alias("digest")), "mem_id", "left")
