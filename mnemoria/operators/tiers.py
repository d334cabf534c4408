"""Tiered memory: importance, decay, promotion and eviction; and short-lived entries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from . import best


@dataclass(frozen=True)
class Config:
    working_capacity: int = 100
    episodic_capacity: int = 10_000
    promote_importance: float = 0.6
    promote_accesses: int = 10
    rate: float = scores.WEEK_RATE


def decay(records: DataFrame, now: float, rate: float = scores.WEEK_RATE) -> DataFrame:
    return records.withColumn("decay", scores.decayed(F.col("importance"), F.col("access_count"), F.col("last_accessed"), now, rate))


def _over_capacity(records: DataFrame, tier: str, capacity: int) -> DataFrame:
    """Rows of ``tier`` that stay: all but the lowest in decay, the earliest ids first among equals.

    The border value comes from one aggregate of the ranks that are over capacity, found by a sort of ids and scores only.
    """
    own = records.where(F.col("tier") == tier)
    keys = own.select("id", "decay").orderBy(F.desc("decay"), F.desc("id")).limit(capacity).select("id")
    return records.where(F.col("tier") != tier).unionByName(own.join(keys, "id", "left_semi"))


def consolidate(records: DataFrame, now: float, config: Config = Config()) -> DataFrame:
    """One cycle over ``records(id, tier, importance, access_count, last_accessed, ...)``.

    Working is cut to its capacity; what is important goes on to Episodic; what is used often goes from there to Semantic, in the same
    cycle too; Episodic is cut. Semantic is never cut.
    """
    r = _over_capacity(decay(records, now, config.rate), "Working", config.working_capacity)
    r = r.withColumn("tier", F.when((F.col("tier") == "Working") & (F.col("importance") > config.promote_importance), "Episodic").otherwise(F.col("tier")))
    r = r.withColumn("tier", F.when((F.col("tier") == "Episodic") & (F.col("access_count") > config.promote_accesses), "Semantic").otherwise(F.col("tier")))
    return _over_capacity(r, "Episodic", config.episodic_capacity)


def tier_stats(records: DataFrame) -> DataFrame:
    return records.groupBy("tier").agg(F.count("*").alias("n"), F.avg("importance").alias("avg_importance"), F.sum("access_count").alias("accesses"), F.max("last_accessed").alias("last"))


def live(entries: DataFrame, now: float) -> DataFrame:
    """Not expired: without an expiry (0), or at it or before it."""
    return entries.where((F.col("expires_at") == 0) | (F.col("expires_at") >= now))


def make_room(entries: DataFrame, now: float, capacity: int) -> DataFrame:
    """Entries after a set at capacity: the expired go first; only if none had expired, the least used, longest untouched one."""
    counts = entries.agg(F.count("*").alias("n"), F.count_if((F.col("expires_at") != 0) & (F.col("expires_at") < now)).alias("gone"))
    worst = entries.orderBy("access_count", "last_accessed", "key").limit(1).select(F.col("key").alias("worst"))
    flagged = entries.crossJoin(F.broadcast(counts)).join(F.broadcast(worst), F.col("key") == F.col("worst"), "left")
    full = F.col("n") >= capacity
    drop = full & F.when(F.col("gone") > 0, (F.col("expires_at") != 0) & (F.col("expires_at") < now)).otherwise(F.col("worst").isNotNull())
    return flagged.where(~drop).drop("n", "gone", "worst")


def promotable(entries: DataFrame, now: float, accesses: int, dim: int) -> DataFrame:
    """Live entries used often enough, as memory rows; a zero vector where there is none."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return live(entries, now).where(F.col("access_count") >= accesses).select("key", F.concat(F.lit("ephemeral::"), "key").alias("source_channel"), F.coalesce("text", F.lit("")).alias("chunk"), F.coalesce("embedding", zero).alias("embedding"), F.lit(1.0).alias("activation"))


def surprise(rows: DataFrame, working: DataFrame, id_col: str = "id", block: int = 16_384) -> DataFrame:
    """``(id, surprise)``: 1 minus the largest cosine with an earlier row (by id) of the working tier, within 0 and 1; 1 where there is none.

    Rows of the working tier are sent to the tasks in blocks, one at a time through the driver, and multiplied there in matrices of a few
    MB, so no pairs are made; a row comes out once for each block. Ids and vectors are kept in the checkpoint folder in the order of ids, so a
    block reads just those, and few rows at once lie on both sides of an id.
    """
    from .graph import cut

    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)  # rows are few bytes and much work
    asked = cut(rows.where(F.col("embedding").isNotNull()).select(F.col(id_col).cast("long").alias("id"), "embedding").repartition(n, "id").sortWithinPartitions("id"))
    out: DataFrame | None = None

    def against(held: list) -> DataFrame:
        ids = np.array([r["id"] for r in held], np.int64)
        sent = spark.sparkContext.broadcast((ids, best.unit(np.array([r["embedding"] for r in held], np.float64))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, v = sent.value
            for b in batches:
                own, top = best.numbers(b.column(0)), np.empty(len(b))
                for at in best.slices(len(b), len(v)):
                    if own[at].max() <= ids[0]:
                        top[at] = -np.inf
                        continue
                    s = best.unit(best.matrix(b.column(1).slice(at.start, at.stop - at.start))) @ v.T
                    if own[at].min() <= ids[-1]:
                        s[ids[None, :] >= own[at][:, None]] = -np.inf
                    top[at] = s.max(1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(top)], names=["id", "top"])

        return asked.mapInArrow(run, "id long, top double")

    held: list = []
    for r in working.where(F.col("embedding").isNotNull()).select(F.col(id_col).cast("long").alias("id"), "embedding").orderBy("id").toLocalIterator():
        held.append(r)
        if len(held) == block:
            out = against(held) if out is None else out.unionByName(against(held))
            held = []
    if held:
        out = against(held) if out is None else out.unionByName(against(held))
    if out is None:
        return asked.select("id", F.lit(1.0).alias("surprise"))
    s = out.groupBy("id").agg(F.max("top").alias("top"))
    top = F.when(F.col("top") > float("-inf"), F.col("top")).otherwise(0.0)
    return s.select("id", F.least(F.greatest(1 - top, F.lit(0.0)), F.lit(1.0)).alias("surprise"))


def evict_rank(records: DataFrame) -> DataFrame:
    """Each record's place in its tier's order of eviction, 1 being the first to go.

    There are three tiers, so all rows are numbered by ranges of (tier, decay, id), and a tier's first number is taken off.
    """
    from .store import numbered

    all_ = numbered(records, ["tier", "decay", "id"], "_n")
    first = all_.groupBy("tier").agg(F.min("_n").alias("_first"))
    return all_.join(F.broadcast(first), "tier").withColumn("evict_rank", (F.col("_n") - F.col("_first") + 1).cast("int")).drop("_n", "_first")
