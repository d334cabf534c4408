"""Registration of queries, and the views that bind operators to the tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import SearchIndex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The time that stands for now wherever an operator needs one.
NOW = 1_700_000_000.0 + 500 * 3600


def query(name: str, sql: str | None = None, views: str = "") -> Callable:
    """Register a builder under ``name``. ``sql`` goes on after the named views: a select, or a comma and more of the WITH list."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            parts = [SQL_VIEWS[v] for v in views.split()]
            body = sql.strip()
            if parts:
                ORACLES[name] = "WITH RECURSIVE " + ", ".join(parts) + " " + body
            else:
                ORACLES[name] = "WITH RECURSIVE " + body[1:].strip() if body.startswith(",") else body
        return fn

    return add


_INDEXES: dict[tuple[str, str], SearchIndex] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder where the driver and all executors can write: in that of spark.checkpoint.dir, a temporary one only where all is one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        return "file://" + tempfile.mkdtemp(prefix="mnemoria-")
    return f"{base.rstrip('/')}/{name}/{uuid.uuid4().hex}"


def search_index(spark: SparkSession, sf: str) -> SearchIndex:
    """The index over the memory view, written when the first query asks for it."""
    key = spark.sparkContext.applicationId, sf
    if key not in _INDEXES:
        _INDEXES[key] = SearchIndex.build(memory(spark, sf), shared_folder(spark, "index") + "/search", texts=_texts(spark, sf))
    return _INDEXES[key]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """The memory view without vectors. Texts meet vectors by a join only where an id has several of them, and so several rows."""
    ids = table(spark, sf, "embeddings").where("vec_id is not null").groupBy("vec_id").agg(F.count("*").alias("n"))
    if ids.where("n > 1").isEmpty():
        return _memory(table(spark, sf, "documents").withColumn("embedding", F.lit(None).cast("array<float>")))
    return memory(spark, sf)


def memory(spark: SparkSession, sf: str) -> DataFrame:
    d, e = table(spark, sf, "documents"), table(spark, sf, "embeddings")
    return _memory(d.join(e, d["doc_id"] == e["vec_id"], "left"))


def _memory(joined: DataFrame) -> DataFrame:
    channel = F.when(F.col("doc_id") % 4 == 0, "user_correction").when(F.col("doc_id") % 4 == 1, "conversation").when(F.col("doc_id") % 4 == 2, "system").otherwise(F.col("source"))
    return joined.select(
        F.col("doc_id").alias("mem_id"),
        F.col("text").alias("chunk"),
        "embedding",
        channel.alias("source_channel"),
        (F.lit(1.7e9) + F.col("doc_id") * 3600).alias("timestamp"),
        F.concat(F.lit("s"), (F.col("doc_id") % 20).cast("string")).alias("session_id"),
        F.col("lang").alias("tags"),
        F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0).alias("tombstone"),
        (1 + 0.15 * (F.col("doc_id") % 3)).alias("activation"),
        "n_chars",
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Write events: seconds since 1970, the user as session, a source for each type."""
    e = table(spark, sf, "events")
    source = F.when(F.col("event_type") == "click", "User").when(F.col("event_type") == "view", "System").when(F.col("event_type") == "purchase", "Tool").when(F.col("event_type") == "signup", "Retrieval").otherwise("Correction")
    return e.select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"), F.col("user_id").alias("session_id"), source.alias("source"), "event_type", "value")


def exchanges(spark: SparkSession, sf: str) -> DataFrame:
    """A user turn and the assistant turn right after it."""
    from pyspark.sql import Window

    c = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt = c.withColumns({"next_role": F.lead("role").over(w), "agent_turn": F.lead("text").over(w)})
    return nxt.where("role = 'user' and next_role = 'assistant'").select("conv_id", F.col("turn").alias("turn_number"), F.col("text").alias("user_turn"), "agent_turn")


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """A session for each user and day; its parent is that of the user's day before, if there is one."""
    from pyspark.sql import Window

    e = events(spark, sf).withColumn("day", F.floor(F.col("timestamp") / 86400).cast("long"))
    s = e.groupBy(F.col("session_id").alias("user_id"), "day").agg(F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"), F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy("day")
    sid = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("day").cast("string"))
    s = s.withColumn("session", sid)
    return s.select("session", "user_id", "start_ts", F.when(F.col("n") % 5 != 0, F.col("end_ts")).alias("end_ts"), F.lag("session").over(w).alias("parent"))


def timeline(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    e = events(spark, sf)
    w = Window.partitionBy("session_id", "event_type").orderBy("timestamp", "event_id")
    return e.select(F.col("session_id").alias("entity_id"), "timestamp", F.col("event_id").alias("seq"), F.col("event_type").alias("property_key"), F.lag("value").over(w).alias("old_value"), F.col("value").alias("new_value"))


def entities(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"), F.lit("region").alias("entity_type")),
        table(spark, sf, "nation").select((F.col("n_nationkey") + 1000).cast("long"), "n_name", F.lit("nation")),
        table(spark, sf, "supplier").select(F.col("s_suppkey") + 1_000_000, "s_name", F.lit("supplier")),
        table(spark, sf, "customer").select(F.col("c_custkey") + 1_000_000_000, "c_name", F.lit("customer")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def edges(spark: SparkSession, sf: str) -> DataFrame:
    n, s, c = (table(spark, sf, t) for t in ("nation", "supplier", "customer"))
    return (
        n.select((F.col("n_nationkey") + 1000).cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("tgt"), F.lit("part_of").alias("relation"), F.lit(1.0).alias("weight"))
        .union(s.select(F.col("s_suppkey") + 1_000_000, (F.col("s_nationkey") + 1000).cast("long"), F.lit("located_in"), F.lit(0.8)))
        .union(c.select(F.col("c_custkey") + 1_000_000_000, (F.col("c_nationkey") + 1000).cast("long"), F.lit("lives_in"), F.lit(0.6)))
    )


def tiered(spark: SparkSession, sf: str) -> DataFrame:
    m = memory(spark, sf).where("tombstone = 0")
    tier = F.when(F.col("mem_id") % 3 == 0, "Working").when(F.col("mem_id") % 3 == 1, "Episodic").otherwise("Semantic")
    source = F.element_at(F.array(*map(F.lit, ["User", "System", "Tool", "Retrieval", "Correction"])), (F.col("mem_id") % 5 + 1).cast("int"))
    return m.select(F.col("mem_id").alias("id"), "chunk", "embedding", tier.alias("tier"), (F.least(F.col("n_chars"), F.lit(4000)) / 4000.0).alias("importance"), (F.col("mem_id") % 15).cast("int").alias("access_count"), F.col("timestamp").alias("last_accessed"), source.alias("source"))


def ephemeral(spark: SparkSession, sf: str) -> DataFrame:
    """Short-lived entries made from memory: every third never expires, the others at different times around now."""
    m = memory(spark, sf)
    expires = F.when(F.col("mem_id") % 3 == 0, F.lit(0.0)).otherwise(F.lit(NOW) + (F.col("mem_id") % 41 - 20) * 60.0)
    return m.select(F.concat(F.lit("k"), F.col("mem_id").cast("string")).alias("key"), F.col("mem_id"), F.when(F.col("mem_id") % 7 != 0, F.col("chunk")).alias("text"), "embedding", F.col("timestamp").alias("last_accessed"), expires.alias("expires_at"), (F.col("mem_id") % 9).cast("int").alias("access_count"))


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings as a two-dimensional array in long form."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("i0"), F.posexplode("embedding").alias("i1", "value")).select("i0", F.col("i1").cast("long").alias("i1"), F.col("value").cast("double").alias("value"))


SQL_VIEWS = {
    "v_memory": """v_memory AS (
      SELECT d.doc_id AS mem_id, d.text AS chunk, CAST(e.embedding AS DOUBLE[]) AS embedding,
        CASE d.doc_id % 4 WHEN 0 THEN 'user_correction' WHEN 1 THEN 'conversation' WHEN 2 THEN 'system' ELSE d.source END AS source_channel,
        1.7e9::DOUBLE + d.doc_id * 3600 AS timestamp, 's' || (d.doc_id % 20) AS session_id, d.lang AS tags,
        CASE WHEN d.doc_id % 10 = 0 THEN 1 ELSE 0 END AS tombstone, 1::DOUBLE + 0.15::DOUBLE * (d.doc_id % 3) AS activation, d.n_chars
      FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)""",
    "v_vec": "v_vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)",
    "v_event": """v_event AS (
      SELECT event_id, epoch_us(ts) / 1e6::DOUBLE AS timestamp, user_id AS session_id,
        CASE event_type WHEN 'click' THEN 'User' WHEN 'view' THEN 'System' WHEN 'purchase' THEN 'Tool' WHEN 'signup' THEN 'Retrieval' ELSE 'Correction' END AS source,
        event_type, value FROM events)""",
    "v_exchange": """v_exchange AS (
      SELECT conv_id, turn AS turn_number, text AS user_turn, agent_turn FROM (
        SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS agent_turn FROM conversations)
      WHERE role = 'user' AND next_role = 'assistant')""",
    "v_session": """v_session AS (
      SELECT session, user_id, start_ts, CASE WHEN n % 5 <> 0 THEN end_ts END AS end_ts, lag(session) OVER (PARTITION BY user_id ORDER BY day) AS parent FROM (
        SELECT session_id AS user_id, CAST(floor(timestamp / 86400) AS BIGINT) AS day, min(timestamp) AS start_ts, max(timestamp) AS end_ts, count(*) AS n,
          session_id || '-' || CAST(floor(timestamp / 86400) AS BIGINT) AS session FROM v_event GROUP BY ALL))""",
    "v_timeline": """v_timeline AS (
      SELECT session_id AS entity_id, timestamp, event_id AS seq, event_type AS property_key,
        lag(value) OVER (PARTITION BY session_id, event_type ORDER BY timestamp, event_id) AS old_value, value AS new_value FROM v_event)""",
    "v_entity": """v_entity AS (
      SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, 'region' AS entity_type FROM region
      UNION ALL SELECT n_nationkey + 1000, n_name, 'nation' FROM nation
      UNION ALL SELECT s_suppkey + 1000000, s_name, 'supplier' FROM supplier
      UNION ALL SELECT c_custkey + 1000000000, c_name, 'customer' FROM customer)""",
    "v_edge": """v_edge AS (
      SELECT CAST(n_nationkey + 1000 AS BIGINT) AS src, CAST(n_regionkey AS BIGINT) AS tgt, 'part_of' AS relation, 1.0::DOUBLE AS weight FROM nation
      UNION ALL SELECT s_suppkey + 1000000, s_nationkey + 1000, 'located_in', 0.8 FROM supplier
      UNION ALL SELECT c_custkey + 1000000000, c_nationkey + 1000, 'lives_in', 0.6 FROM customer)""",
    "v_tier": """v_tier AS (
      SELECT mem_id AS id, chunk, embedding, CASE mem_id % 3 WHEN 0 THEN 'Working' WHEN 1 THEN 'Episodic' ELSE 'Semantic' END AS tier,
        least(n_chars, 4000) / 4000.0::DOUBLE AS importance, mem_id % 15 AS access_count, timestamp AS last_accessed,
        ['User', 'System', 'Tool', 'Retrieval', 'Correction'][mem_id % 5 + 1] AS source FROM v_memory WHERE tombstone = 0)""",
    "v_ephemeral": f"""v_ephemeral AS (
      SELECT 'k' || mem_id AS key, mem_id, CASE WHEN mem_id % 7 <> 0 THEN chunk END AS text, embedding, timestamp AS last_accessed,
        CASE WHEN mem_id % 3 = 0 THEN 0.0 ELSE {NOW}::DOUBLE + (mem_id % 41 - 20) * 60.0 END AS expires_at, mem_id % 9 AS access_count FROM v_memory)""",
    "v_grid": """v_grid AS (
      SELECT vec_id AS i0, CAST(unnest(range(len(embedding))) AS BIGINT) AS i1, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)""",
}
