"""Lifecycle of a memory table: upsert, tombstones, compaction, change logs, weights, migration."""

from __future__ import annotations

import uuid
from itertools import accumulate

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _part_of(df: DataFrame, order: list[str], n: int) -> Column:
    """Which of ``n`` ranges of the order a row lies in: a function of its keys alone, so every evaluation of a plan deals rows alike.

    The borders are keys of a sample that the driver holds, about 20 for each range. A row's range is the count of borders up to its key.
    """
    drawn = df.select(*order).withColumn("_drawn", F.rand(n)).orderBy("_drawn").limit(20 * n).drop("_drawn").orderBy(*order).collect()
    borders = [drawn[len(drawn) * i // n] for i in range(1, n)] if drawn else []
    kinds = [df.schema[c].dataType for c in order]
    known = F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for c, v, t in zip(order, row, kinds, strict=True)]) for row in borders])
    steps = [1 << i for i in reversed(range(len(borders).bit_length()))]
    if not steps:
        return F.lit(0)
    key = F.struct(*order)
    below = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(known, at + step - 1) <= key, at + step).otherwise(at))
    return F.coalesce(below, F.lit(0))


def numbered(df: DataFrame, order: list[str], name: str, start: int = 0, partitions: int | None = None) -> DataFrame:
    """Consecutive numbers in the given order, without bringing all rows into one task.

    Rows are dealt by range and numbered within each part; a part's first number is the count of those before it. Spark's own dealing by range
    draws other borders each time a plan is evaluated, and the counts are an evaluation of their own: so the borders are fixed first.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.withColumn("_part", _part_of(df, order, n))
    sizes = {r["_part"]: r["n"] for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row for each part
    first = list(accumulate((sizes.get(p, 0) for p in range(n)), initial=start))
    w = Window.partitionBy("_part").orderBy(*order)
    own = parts.repartitionById(n, F.col("_part")).withColumn("_nth", F.row_number().over(w) - 1)
    before = F.array(*[F.lit(x).cast("long") for x in first])
    return own.withColumn(name, F.col("_nth") + F.get(before, F.col("_part"))).drop("_part", "_nth")


def append(memory: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """``new`` after ``memory``, ids going on from the largest; defaults as for a fresh row."""
    most = memory.agg(F.coalesce(F.max("mem_id") + 1, F.lit(0)).alias("_first"))
    rows = numbered(new, order, "_k").crossJoin(F.broadcast(most)).withColumn("mem_id", F.col("_k") + F.col("_first")).drop("_k", "_first")
    return memory.unionByName(rows.withColumns({"tombstone": F.lit(0), "activation": F.lit(1.0)}).select(*memory.columns))


def upsert(memory: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """``new(key, values)`` over the first active row of each non-empty key, which keeps its id and is as fresh as new; others are appended."""
    active = memory.where((F.coalesce(F.col("tombstone"), F.lit(0)) == 0) & (F.coalesce(F.col(key), F.lit("")) != ""))
    first = active.groupBy(key).agg(F.min("mem_id").alias("mem_id"))
    n = new.select(F.col(key).alias("_key"), *[F.col(v).alias(f"_{v}") for v in values])
    hit = first.join(n, F.col(key) == F.col("_key")).drop(key)
    old = memory.join(hit, "mem_id", "left")
    done = old.withColumns({v: F.when(F.col("_key").isNotNull(), F.col(f"_{v}")).otherwise(F.col(v)) for v in values} | {"activation": F.when(F.col("_key").isNotNull(), F.lit(1.0)).otherwise(F.col("activation"))}).select(*memory.columns)
    fresh = new.join(first.select(key), key, "left_anti")
    blank = fresh.select(*[F.col(c) if c in [key, *values] else F.lit(None).cast(memory.schema[c].dataType).alias(c) for c in memory.columns])
    return append(done, blank, [key])


def delete(memory: DataFrame, ids: DataFrame) -> DataFrame:
    """Mark rows as deleted; check with ``undeletable`` first where a missing id is an error."""
    hit = ids.select("mem_id").distinct().withColumn("_hit", F.lit(True))
    return memory.join(hit, "mem_id", "left").withColumn("tombstone", F.when(F.col("_hit"), 1).otherwise(F.col("tombstone"))).drop("_hit")


def undeletable(memory: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids that are not there or are deleted already."""
    return ids.join(memory.where(F.coalesce(F.col("tombstone"), F.lit(0)) == 0).select("mem_id"), "mem_id", "left_anti")


def needs_compaction(memory: DataFrame, threshold: float = 0.3) -> DataFrame:
    return memory.agg(F.avg(F.coalesce(F.col("tombstone"), F.lit(0)).cast("double")).alias("fraction")).withColumn("compact", F.coalesce(F.col("fraction") > threshold, F.lit(False)))


def compact(memory: DataFrame) -> DataFrame:
    """Active rows, renumbered from 0; ``old_id`` is the map back."""
    active = memory.where(F.coalesce(F.col("tombstone"), F.lit(0)) == 0).withColumnRenamed("mem_id", "old_id")
    return numbered(active, ["old_id"], "mem_id")


def delete_and_compact(memory: DataFrame, ids: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Delete, and compact if more than ``threshold`` of all rows are then deleted; ``old_id`` is the id before, the same where nothing was compacted."""
    left = delete(memory, ids)
    if needs_compaction(left, threshold).first()["compact"]:
        return compact(left)
    return left.withColumn("old_id", F.col("mem_id"))


def run_compaction(memory: DataFrame, factor: float = 0.98) -> DataFrame:
    """What a session's end does: weights decay, deleted rows go, ids are renumbered (``old_id`` is the map back). Write it with ``flush``."""
    return compact(tick(memory, factor))


def run_consolidation(memory: DataFrame, now: float, config: object = None) -> DataFrame:
    """One row of counts of a trial cycle over the active rows; nothing is written back.

    Every row begins in Working, as important as it is active, not yet used, touched now.
    """
    from . import tiers

    config = config or tiers.Config()
    active = memory.where(F.coalesce(F.col("tombstone"), F.lit(0)) == 0)
    records = active.select(F.col("mem_id").alias("id"), F.lit("Working").alias("tier"), F.col("activation").alias("importance"), F.lit(0).alias("access_count"), F.lit(now).alias("last_accessed"))
    n = lambda tier: F.count_if(F.col("tier") == tier).alias(tier.lower())
    after = tiers.consolidate(records, now, config).agg(n("Working"), n("Episodic"), n("Semantic"))
    total = records.agg(F.count("*").alias("total"))
    return after.crossJoin(F.broadcast(total)).withColumn("evicted", F.col("total") - F.col("working") - F.col("episodic") - F.col("semantic"))


def record(memory: DataFrame, entries: DataFrame, order: list[str]) -> DataFrame:
    """Append what a strategy saves of exchanges, in the given order; columns that entries lack are null."""
    own = [F.col(c) if c in entries.columns else F.lit(None).cast(memory.schema[c].dataType).alias(c) for c in memory.columns if c != "mem_id"]
    rows = entries.select(*own, *[c for c in order if c not in memory.columns])
    rows = rows.withColumn("mem_id", F.lit(None).cast("long"))
    return append(memory, rows, order)


def flush(df: DataFrame, folder: str) -> str:
    """Write all of ``df`` as the next version of the table in ``folder``; it becomes the current one when it is whole.

    A version is written under a name of its own, so readers go on with theirs and a lost job leaves the current one as it was. The last
    row of the table of versions names the current one.
    """
    spark = df.sparkSession
    path = f"{folder}/data/{uuid.uuid4().hex}"
    df.write.parquet(path)
    n = len(_versions(spark, folder))
    spark.createDataFrame([(n, path)], "version long, path string").coalesce(1).write.mode("append").parquet(f"{folder}/versions")
    return path


def _versions(spark: SparkSession, folder: str) -> list:
    try:
        return spark.read.schema("version long, path string").parquet(f"{folder}/versions").orderBy("version").collect()  # a row for each flush
    except AnalysisException:
        return []


def current(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(_versions(spark, folder)[-1]["path"])


def snapshot(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """A copy of the current version, whole or not there."""
    current(spark, folder).write.parquet(target)
    return spark.read.parquet(target)


def mark_verified(provenance: DataFrame, ids: DataFrame) -> DataFrame:
    """``provenance(record_id, verified, ...)`` with those of ``ids(record_id)`` verified."""
    hit = ids.select("record_id").distinct().withColumn("_hit", F.lit(True))
    return provenance.join(hit, "record_id", "left").withColumn("verified", F.coalesce(F.col("_hit"), F.lit(False)) | F.col("verified")).drop("_hit")


def replay(memory: DataFrame, log: DataFrame) -> DataFrame:
    """Fold a change log ``(seq, op, mem_id, chunk)``: saves append in order, then tombstones apply to what is there."""
    saves = log.where("op = 'save'").select("seq", "chunk")
    columns = [F.col(c) if c in ("seq", "chunk") else F.lit(None).cast(memory.schema[c].dataType).alias(c) for c in [*memory.columns, "seq"] if c != "mem_id"]
    grown = append(memory, saves.select(*columns), ["seq"])
    return delete(grown, log.where("op = 'tombstone'").select("mem_id"))


def boost(memory: DataFrame, hits: DataFrame, by: float = 0.15) -> DataFrame:
    """What was returned becomes more active."""
    h = hits.select(F.col("id").alias("mem_id")).distinct().withColumn("_hit", F.lit(True))
    return memory.join(F.broadcast(h), "mem_id", "left").withColumn("activation", F.col("activation") + F.when(F.col("_hit"), by).otherwise(0.0)).drop("_hit")


def tick(memory: DataFrame, factor: float = 0.98) -> DataFrame:
    return memory.withColumn("activation", F.col("activation") * factor)


def stats(memory: DataFrame) -> DataFrame:
    active = F.coalesce(F.col("tombstone"), F.lit(0)) == 0
    return memory.agg(F.count("*").alias("n"), F.count_if(active).alias("n_active"), F.count_if(active & (F.coalesce(F.size("embedding"), F.lit(0)) > 0)).alias("n_embedded"), F.max(F.when(active, F.col("timestamp"))).alias("last"), F.count_distinct(F.when(active, F.col("source_channel"))).alias("n_channels"))


def migrate(target: DataFrame, source: DataFrame, id_col: str) -> DataFrame:
    """Incremental: what the source has beyond the target's largest id, deleted rows left out."""
    most = target.agg(F.coalesce(F.max(id_col), F.lit(-1)).alias("_most"))
    fresh = source.crossJoin(F.broadcast(most)).where((F.col(id_col) > F.col("_most")) & (F.coalesce(F.col("tombstone"), F.lit(0)) == 0)).drop("_most")
    return target.unionByName(fresh.select(*target.columns))


def validate(source: DataFrame, target: DataFrame, id_col: str, vector: str, texts: list[str], absolute: float = 1e-4, relative: float = 0.0) -> DataFrame:
    """``(id, problem)`` where the two tables differ: a row missing on either side, another text, or a component off by more than the tolerance."""
    s = source.select(id_col, F.col(vector).alias("_sv"), F.lit(1).alias("_s"), *[F.col(t).alias(f"_s_{t}") for t in texts])
    t = target.select(id_col, F.col(vector).alias("_tv"), F.lit(1).alias("_t"), *[F.col(x).alias(f"_t_{x}") for x in texts])
    j = s.join(t, id_col, "full_outer")
    off = F.exists(F.zip_with("_sv", "_tv", lambda a, b: F.abs(a - b) > absolute + relative * F.abs(a)), lambda x: F.coalesce(x, F.lit(True)))
    problem = F.when(F.col("_t").isNull(), "missing in target").when(F.col("_s").isNull(), "missing in source")
    for x in texts:
        problem = problem.when(~F.col(f"_s_{x}").eqNullSafe(F.col(f"_t_{x}")), f"{x} differs")
    problem = problem.when(F.coalesce(off, F.col("_sv").isNull() != F.col("_tv").isNull()), f"{vector} differs")
    return j.select(F.col(id_col).alias("id"), problem.alias("problem")).where("problem is not null")
