"""Time: ranges, sessions and their chains, entity state as of a moment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def between(rows: DataFrame, lo: float, hi: float) -> DataFrame:
    """Both ends included."""
    return rows.where(F.col("timestamp").between(lo, hi))


def latest(rows: DataFrame, n: int, id_col: str) -> DataFrame:
    return rows.orderBy(F.desc("timestamp"), F.desc(id_col)).limit(n)


def earliest(rows: DataFrame, n: int, id_col: str) -> DataFrame:
    return rows.orderBy("timestamp", id_col).limit(n)


def before(rows: DataFrame, t: float, n: int, id_col: str) -> DataFrame:
    """The last ``n`` strictly before ``t``."""
    return latest(rows.where(F.col("timestamp") < t), n, id_col)


def after(rows: DataFrame, t: float, n: int, id_col: str) -> DataFrame:
    return earliest(rows.where(F.col("timestamp") > t), n, id_col)


def overlapping(sessions: DataFrame, lo: float, hi: float) -> DataFrame:
    """Sessions that share a moment with the range; an open one has no end."""
    return sessions.where((F.col("start_ts") <= hi) & (F.coalesce("end_ts", F.lit(float("inf"))) >= lo))


def chains(sessions: DataFrame, starts: DataFrame) -> DataFrame:
    """``(start, session, steps)``: from each of ``starts(session)`` up through its parents; stops where a parent is missing or met before.

    Jumps double in length, so a chain of n sessions takes log n joins. What a cycle meets again counts at its first meeting.
    """
    known = sessions.select(F.col("session").alias("at"))
    jump = cut(sessions.where("parent is not null").select(F.col("session").alias("at"), F.col("parent").alias("to")).join(known.select(F.col("at").alias("to")), "to", "left_semi"))
    reach = starts.select(F.col("session").alias("start"), F.col("session").alias("at")).join(known, "at", "left_semi").withColumn("steps", F.lit(0).cast("long"))
    reach = cut(reach.distinct())
    size, length = reach.count(), 1
    while True:
        more = reach.join(jump, "at").select("start", F.col("to").alias("at"), (F.col("steps") + length).alias("steps"))
        reach = cut(reach.unionByName(more).groupBy("start", "at").agg(F.min("steps").alias("steps")))
        before, size, length = size, reach.count(), 2 * length
        if size == before:  # neither a longer chain nor a cycle adds anything
            break
        far = jump.select(F.col("at").alias("to"), F.col("to").alias("end"))
        jump = cut(jump.join(far, "to").select("at", F.col("end").alias("to")))
    return reach.select("start", F.col("at").alias("session"), "steps")


def state_at(timeline: DataFrame, t: float) -> DataFrame:
    """``(entity_id, property_key, value)``: the last change of each property up to and including ``t``."""
    seen = timeline.where(F.col("timestamp") <= t)
    return seen.groupBy("entity_id", "property_key").agg(F.max_by("new_value", F.struct("timestamp", "seq")).alias("value"))


def as_of(asked: DataFrame, timeline: DataFrame) -> DataFrame:
    """The value of ``(entity_id, property_key)`` as of each asked ``timestamp``; null before the first change.

    Both sides are laid on one line for each key and the last known value is carried along; no pairs are made.
    """
    keys = ["entity_id", "property_key"]
    q = asked.select(*keys, "timestamp", F.lit(None).cast("long").alias("seq"), F.lit(1).alias("asks"), F.lit(None).cast("double").alias("value"), F.col("ask_id"))
    c = timeline.select(*keys, "timestamp", "seq", F.lit(0).alias("asks"), F.col("new_value").alias("value"), F.lit(None).cast("long").alias("ask_id"))
    w = Window.partitionBy(*keys).orderBy("timestamp", "asks", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return q.unionByName(c).withColumn("value", F.last("value", ignorenulls=True).over(w)).where("asks = 1").select("ask_id", *keys, "timestamp", "value")
