"""What of a conversation is saved, and when writes look wrong."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .retrieval import batch_topk


def save_every(exchanges: DataFrame, mode: str = "combined") -> DataFrame:
    """Rows to save for each exchange: both turns as one text, either turn, or both; messages that the gate stops are left out, and so are null ones."""
    both = F.concat("user_turn", F.lit("\n---\n"), "agent_turn")
    keep = exchanges.where(text.gate_reason(F.coalesce("user_turn", F.lit(""))).isNull())
    base = [c for c in exchanges.columns if c not in ("user_turn", "agent_turn")]
    one = lambda c, channel: keep.select(*base, c.alias("chunk"), F.lit(channel).alias("source_channel"))
    if mode == "combined":
        return one(both, "exchange")
    if mode == "user":
        return one(F.col("user_turn"), "user")
    if mode == "agent":
        return one(F.col("agent_turn"), "agent")
    return one(F.col("user_turn"), "user").unionByName(one(F.col("agent_turn"), "agent"))


def on_correction(exchanges: DataFrame, otherwise: Callable[[DataFrame], DataFrame] = save_every) -> DataFrame:
    """Corrections are saved whatever the gate says; what becomes of the other exchanges is up to another strategy."""
    corrects = F.coalesce(text.is_correction(F.col("user_turn")), F.lit(False))
    base = [c for c in exchanges.columns if c not in ("user_turn", "agent_turn")]
    own = exchanges.where(corrects).select(*base, F.concat("user_turn", F.lit("\n---\n"), "agent_turn").alias("chunk"), F.lit("correction").alias("source_channel"))
    return own.unionByName(otherwise(exchanges.where(~corrects)))


def semantic_shift(new: DataFrame, stored: DataFrame, threshold: float = 0.25) -> DataFrame:
    """``(id, top, decision)`` for ``new(id, embedding)``: Duplicate if the nearest row of the store is closer than the shift asks.

    New rows are what is about to be saved. They are held against the whole store in blocks, a product of matrices in each task, and
    each task gives one number for each of them. A row without an embedding, or an empty store, has no top.
    """
    top = batch_topk(stored, new.select(F.col("id").alias("query_id"), "embedding").where("embedding is not null"), 1, "id")
    j = new.select("id").join(top.select(F.col("query_id").alias("id"), F.col("score").alias("top")), "id", "left")
    return j.withColumn("decision", F.when(F.coalesce(F.col("top"), F.lit(-1.0)) > 1 - threshold, "Duplicate").otherwise("Save"))


def _micros() -> Column:
    """Frames of a range are whole numbers."""
    return F.round(F.col("timestamp") * 1e6).cast("long")


def _over_past(events: DataFrame, window: float, **marks: Column) -> DataFrame:
    """``events`` with sums of ``marks`` over all events of the ``window`` seconds up to each of them, both ends included.

    A window over everything would be one sorted run, so events are dealt by spans of time as long as the window. In its own span an event
    counts from its time on; in the next one it counts from the start until it is too old. So a sum is a running one plus that of all who look
    on from the span before: each row is added once, however many events a window holds.
    """
    micros = round(window * 1e6)
    span = F.floor(F.col("_at") / micros).cast("long")
    at = events.withColumn("_at", _micros()).withColumns({f"_{k}": v for k, v in marks.items()})
    both = at.withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False))))
    both = both.withColumns({"_span": F.when(F.col("_own"), span).otherwise(span + 1), "_at": F.when(F.col("_own"), F.col("_at")).otherwise(F.col("_at") + micros + 1)})
    so_far = Window.partitionBy("_span").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy("_span").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = {k: F.sum(F.when(F.col("_own"), F.col(f"_{k}")).otherwise(-F.col(f"_{k}"))).over(so_far) + F.sum(F.when(F.col("_own"), 0).otherwise(F.col(f"_{k}"))).over(every) for k in marks}
    return both.withColumns(sums).where("_own").drop("_at", "_own", "_span", *[f"_{k}" for k in marks])


def rate_alerts(events: DataFrame, most: int = 60, window: float = 60.0) -> DataFrame:
    """All writes in the minute up to each event, the event included, and the alert they raise."""
    e = _over_past(events, window, in_window=F.lit(1).cast("long"))
    return e.withColumn("severity", F.when(F.col("in_window") > 3 * most, "Critical").when(F.col("in_window") > 2 * most, "High").when(F.col("in_window") > most, "Medium"))


def session_alerts(events: DataFrame, most: int = 500) -> DataFrame:
    return events.groupBy("session_id").agg(F.count("*").alias("writes")).withColumn("severity", F.when(F.col("writes") > most, "High"))


def source_alerts(events: DataFrame, least: int = 10, share: float = 0.8, window: float = 60.0) -> DataFrame:
    """The share of user writes among all in the minute up to each event; an alert over ``share`` of at least ``least`` writes."""
    e = _over_past(events, window, in_window=F.lit(1).cast("long"), _users=F.coalesce(F.col("source") == "User", F.lit(False)).cast("long"))
    e = e.withColumn("user_share", F.col("_users") / F.col("in_window")).drop("_users")
    hit = (F.col("in_window") >= least) & (F.col("user_share") > share)
    return e.withColumn("severity", F.when(hit & (F.col("user_share") >= 0.95), "High").when(hit, "Medium"))
