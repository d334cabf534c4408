"""Temporal queries over events, sessions and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import temporal as T
from .base import events, query, sessions, timeline

LO, HI = 1_704_500_000.0, 1_705_200_000.0


@query("temporal_range", f" SELECT event_id, timestamp FROM v_event WHERE timestamp BETWEEN {LO} AND {HI}", "v_event")
def temporal_range(spark: SparkSession, sf: str) -> DataFrame:
    return T.between(events(spark, sf), LO, HI).select("event_id", "timestamp")


@query("temporal_latest", " SELECT * FROM (SELECT 'latest' AS kind, event_id, timestamp FROM v_event ORDER BY timestamp DESC, event_id DESC LIMIT 25) UNION ALL SELECT * FROM (SELECT 'earliest', event_id, timestamp FROM v_event ORDER BY timestamp, event_id LIMIT 25)", "v_event")
def temporal_latest(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).select("event_id", "timestamp")
    return T.latest(e, 25, "event_id").withColumn("kind", F.lit("latest")).unionByName(T.earliest(e, 25, "event_id").withColumn("kind", F.lit("earliest")))


@query("temporal_before_after", f" SELECT * FROM (SELECT 'before' AS kind, event_id, timestamp FROM v_event WHERE timestamp < {LO} ORDER BY timestamp DESC, event_id DESC LIMIT 25) UNION ALL SELECT * FROM (SELECT 'after', event_id, timestamp FROM v_event WHERE timestamp > {LO} ORDER BY timestamp, event_id LIMIT 25)", "v_event")
def temporal_before_after(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).select("event_id", "timestamp")
    return T.before(e, LO, 25, "event_id").withColumn("kind", F.lit("before")).unionByName(T.after(e, LO, 25, "event_id").withColumn("kind", F.lit("after")))


@query(
    "session_chain",
    """, starts AS (SELECT session FROM v_session QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY start_ts DESC) = 1),
 c AS (SELECT s.session AS start, s.session, s.parent, 0 AS steps FROM v_session s JOIN starts USING (session) UNION ALL SELECT c.start, p.session, p.parent, c.steps + 1 FROM c JOIN v_session p ON p.session = c.parent)
 SELECT start, session, steps FROM c""",
    "v_event v_session",
)
def session_chain(spark: SparkSession, sf: str) -> DataFrame:
    s = sessions(spark, sf)
    last = s.groupBy("user_id").agg(F.max_by("session", "start_ts").alias("session"))
    return T.chains(s, last)


@query("session_overlap", f" SELECT session, start_ts, end_ts FROM v_session WHERE start_ts <= {LO + 3600} AND coalesce(end_ts, 'infinity'::DOUBLE) >= {LO}", "v_event v_session")
def session_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return T.overlapping(sessions(spark, sf), LO, LO + 3600).select("session", "start_ts", "end_ts")


@query("session_children", " SELECT parent AS session, count(*) AS n_children, min(session) AS first_child FROM v_session WHERE parent IS NOT NULL GROUP BY parent", "v_event v_session")
def session_children(spark: SparkSession, sf: str) -> DataFrame:
    return sessions(spark, sf).where("parent is not null").groupBy(F.col("parent").alias("session")).agg(F.count("*").alias("n_children"), F.min("session").alias("first_child"))


@query("timeline_history", " SELECT entity_id, property_key, timestamp, old_value, new_value FROM v_timeline", "v_event v_timeline")
def timeline_history(spark: SparkSession, sf: str) -> DataFrame:
    return timeline(spark, sf).select("entity_id", "property_key", "timestamp", "old_value", "new_value")


@query("timeline_state_at", f" SELECT entity_id, property_key, arg_max(new_value, (timestamp, seq)) AS value FROM v_timeline WHERE timestamp <= {HI} GROUP BY ALL", "v_event v_timeline")
def timeline_state_at(spark: SparkSession, sf: str) -> DataFrame:
    return T.state_at(timeline(spark, sf), HI)


@query(
    "timeline_as_of",
    """, asked AS (SELECT event_id AS ask_id, session_id AS entity_id, 'click' AS property_key, timestamp FROM v_event WHERE event_type = 'purchase')
 SELECT a.ask_id, a.entity_id, a.property_key, a.timestamp, c.new_value AS value FROM asked a ASOF LEFT JOIN (SELECT entity_id, property_key, timestamp, arg_max(new_value, seq) AS new_value FROM v_timeline GROUP BY ALL) c
 ON a.entity_id = c.entity_id AND a.property_key = c.property_key AND a.timestamp >= c.timestamp""",
    "v_event v_timeline",
)
def timeline_as_of(spark: SparkSession, sf: str) -> DataFrame:
    asked = events(spark, sf).where("event_type = 'purchase'").select(F.col("event_id").alias("ask_id"), F.col("session_id").alias("entity_id"), F.lit("click").alias("property_key"), "timestamp")
    return T.as_of(asked, timeline(spark, sf))
