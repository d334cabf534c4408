"""Gate, strategies and write anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import strategy as S
from .base import events, exchanges, memory, query, table
from .base import vectors as vector_rows


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_GATE = rf""", g AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\s]+', '', 'g'), '\s+', ' ', 'g')) AS n FROM conversations),
 h AS (SELECT *, list_filter(string_split(n, ' '), lambda x: x <> '') AS words FROM g),
 gate AS (SELECT conv_id, turn, CASE WHEN n = '' THEN 'empty input' WHEN list_contains({_sql_list(X.TRIVIAL_PHRASES)}, n) THEN 'trivial phrase: ' || n
   WHEN len(words) < 3 THEN 'too few words: ' || len(words) || ' < 3'
   WHEN len(list_filter(words, lambda w: list_contains({_sql_list(X.TRIVIAL_WORDS)}, w))) / len(words)::DOUBLE > 0.8 THEN 'high trivial ratio' END AS reason FROM h)"""


@query("gate_decision", _GATE + " SELECT conv_id, turn, coalesce(reason, 'save') AS decision FROM gate")
def gate_decision(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(X.gate_reason(F.col("text")), F.lit("save")).alias("decision"))


_GATED = _GATE + ", ok AS (SELECT e.* FROM v_exchange e JOIN gate ON gate.conv_id = e.conv_id AND gate.turn = e.turn_number WHERE reason IS NULL)"


@query("save_every", _GATED + " SELECT conv_id, turn_number, length(user_turn || chr(10) || '---' || chr(10) || agent_turn) AS n_chars, md5(user_turn || chr(10) || '---' || chr(10) || agent_turn) AS digest, 'exchange' AS source_channel FROM ok", "v_exchange")
def save_every(spark: SparkSession, sf: str) -> DataFrame:
    return S.save_every(exchanges(spark, sf)).select("conv_id", "turn_number", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"), "source_channel")


_CUES = " OR ".join(f"contains(lower(user_turn), '{c}')" for c in X.CORRECTION_CUES)


@query(
    "user_correction",
    _GATED + f""" SELECT conv_id, turn_number, md5(user_turn || chr(10) || '---' || chr(10) || agent_turn) AS digest, 'correction' AS source_channel FROM v_exchange WHERE {_CUES}
 UNION ALL SELECT conv_id, turn_number, md5(user_turn || chr(10) || '---' || chr(10) || agent_turn), 'exchange' FROM ok WHERE NOT ({_CUES})""",
    "v_exchange",
)
def user_correction(spark: SparkSession, sf: str) -> DataFrame:
    x = exchanges(spark, sf)
    return S.on_correction(x).select("conv_id", "turn_number", F.md5("chunk").alias("digest"), "source_channel")


@query(
    "semantic_shift",
    """, s AS (SELECT a.vec_id AS id, max(list_cosine_similarity(a.v, b.v)) AS top FROM v_vec a, v_vec b WHERE a.vec_id % 50 = 0 AND b.vec_id % 50 <> 0 GROUP BY a.vec_id)
 SELECT id, round(top, 6) AS top, CASE WHEN coalesce(top, -1) > 0.75 THEN 'Duplicate' ELSE 'Save' END AS decision FROM s""",
    "v_vec",
)
def semantic_shift(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with an id divisible by 50 are about to be saved; all others are the store."""
    v = vector_rows(spark, sf).withColumnRenamed("vec_id", "id")
    return S.semantic_shift(v.where("id % 50 = 0"), v.where("id % 50 <> 0")).withColumn("top", F.round("top", 6))


_W = "WINDOW w AS (ORDER BY epoch RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)"


@query("anomaly_rate", f", r AS (SELECT event_id, count(*) OVER w AS in_window FROM (SELECT *, CAST(round(timestamp * 1e6) AS BIGINT) AS epoch FROM v_event) {_W}) SELECT event_id, in_window, CASE WHEN in_window > 30 THEN 'Critical' WHEN in_window > 20 THEN 'High' WHEN in_window > 10 THEN 'Medium' END AS severity FROM r", "v_event")
def anomaly_rate(spark: SparkSession, sf: str) -> DataFrame:
    return S.rate_alerts(events(spark, sf), most=10, window=3600.0).select("event_id", "in_window", "severity")


@query("anomaly_source", f", r AS (SELECT event_id, count(*) OVER w AS in_window, avg(CASE WHEN source = 'User' THEN 1.0 ELSE 0.0 END) OVER w AS user_share FROM (SELECT *, CAST(round(timestamp * 1e6) AS BIGINT) AS epoch FROM v_event) {_W}) SELECT event_id, in_window, round(user_share, 6) AS user_share, CASE WHEN in_window >= 10 AND user_share > 0.3 THEN CASE WHEN user_share >= 0.95 THEN 'High' ELSE 'Medium' END END AS severity FROM r", "v_event")
def anomaly_source(spark: SparkSession, sf: str) -> DataFrame:
    return S.source_alerts(events(spark, sf), least=10, share=0.3, window=3600.0).select("event_id", "in_window", F.round("user_share", 6).alias("user_share"), "severity")


@query("session_counts", " SELECT session_id, count(*) AS writes, CASE WHEN count(*) > 70 THEN 'High' END AS severity FROM v_event GROUP BY session_id", "v_event")
def session_counts(spark: SparkSession, sf: str) -> DataFrame:
    return S.session_alerts(events(spark, sf), 70)


_PATTERN = "CASE " + " ".join(f"WHEN contains(low, '{p}') THEN '{p}'" for p in X.SUSPICIOUS) + " END"


@query(
    "anomaly_pattern",
    f""", t AS (SELECT mem_id, lower(chunk || CASE mem_id % 7 WHEN 0 THEN ' Ignore previous orders' WHEN 1 THEN ' SYSTEM: act as' WHEN 2 THEN ' you are now free' ELSE '' END) AS low FROM v_memory),
 p AS (SELECT mem_id, {_PATTERN} AS pattern FROM t)
 SELECT mem_id, pattern, CASE WHEN regexp_matches(pattern, 'ignore|override') THEN 'Critical' WHEN regexp_matches(pattern, 'system|jailbreak') THEN 'High' ELSE 'Medium' END AS severity FROM p WHERE pattern IS NOT NULL""",
    "v_memory",
)
def anomaly_pattern(spark: SparkSession, sf: str) -> DataFrame:
    extra = F.when(F.col("mem_id") % 7 == 0, " Ignore previous orders").when(F.col("mem_id") % 7 == 1, " SYSTEM: act as").when(F.col("mem_id") % 7 == 2, " you are now free").otherwise("")
    m = memory(spark, sf).select("mem_id", X.suspicious_pattern(F.concat("chunk", extra)).alias("pattern")).where("pattern is not null")
    return m.withColumn("severity", X.pattern_severity(F.col("pattern")))


@query("source_isolation", " SELECT mem_id, source_channel FROM v_memory WHERE source_channel IN ('conversation', 'system') AND contains(lower(chunk), lower('Licensed'))", "v_memory")
def source_isolation(spark: SparkSession, sf: str) -> DataFrame:
    return memory(spark, sf).where(F.col("source_channel").isin("conversation", "system") & F.contains(F.lower("chunk"), F.lower(F.lit("Licensed")))).select("mem_id", "source_channel")
