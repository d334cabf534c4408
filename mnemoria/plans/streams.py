"""Streaming queries, run to the end of what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import cut
from ..streaming import windows as W
from .base import query, shared_folder, table


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """All rows that a query puts out until its input is used up, as a table."""
    folder = shared_folder(spark, "streams")
    out = f"{folder}/out"

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/part={n}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).drop("part")


@query("stream_rate", " SELECT CAST(epoch(time_bucket(INTERVAL '1 hour', ts)) AS BIGINT) AS window_start, user_id AS session_id, count(*) AS n FROM events GROUP BY ALL")
def stream_rate(spark: SparkSession, sf: str) -> DataFrame:
    s = W.write_rate(_stream(spark, sf).withColumnRenamed("user_id", "session_id"), most=2, window="1 hour", late="40 days")
    out = _run(spark, s, "update")
    last = out.groupBy("window_start", "session_id").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.unix_seconds("window_start").alias("window_start"), "session_id", "n")


def _resumed(spark: SparkSession, sf: str, parts: list[str], shape: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All that a query puts out which is run once for each of ``parts`` (conditions on events): files come, it goes on from its checkpoint, and ends.

    ``run`` counts the runs, ``batch`` the batches of all of them.
    """
    folder = shared_folder(spark, "streams")
    e = table(spark, sf, "events")
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    for run, part in enumerate(parts):
        e.where(part).write.parquet(f"{folder}/in/{run}")

        def write(batch: DataFrame, n: int, run: int = run) -> None:
            batch.withColumns({"batch": F.lit(n), "run": F.lit(run)}).write.mode("overwrite").parquet(f"{folder}/out/part={n}")

        stream = spark.readStream.schema(e.schema).parquet(f"{folder}/in/*")
        shape(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("part")


@query(
    "stream_late",
    """, a AS (SELECT max(epoch_us(ts)) - 3600000000 AS mark FROM events WHERE event_id % 2 = 0)
 SELECT CAST(epoch(time_bucket(INTERVAL '1 hour', ts)) AS BIGINT) AS window_start, user_id AS session_id, count(*) AS n FROM events, a WHERE event_id % 2 = 0 OR epoch_us(time_bucket(INTERVAL '1 hour', ts)) + 3600000000 > mark GROUP BY ALL""",
)
def stream_late(spark: SparkSession, sf: str) -> DataFrame:
    """Every second event comes a run later: those whose window has closed by then are dropped."""
    rate = lambda s: W.write_rate(s.withColumnRenamed("user_id", "session_id"), most=2, window="1 hour", late="1 hour")
    out = _resumed(spark, sf, ["event_id % 2 = 0", "event_id % 2 = 1"], rate)
    last = out.groupBy("window_start", "session_id").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.unix_seconds("window_start").alias("window_start"), "session_id", "n")


_TTL = 12 * 3600


@query(
    "stream_ttl",
    f""", e AS (SELECT user_id AS key, value, ts, epoch_us(ts) // 1000 AS ms, ts < TIMESTAMP '2024-01-20' AS early FROM events), m AS (SELECT max(ms) - 60000 AS mark FROM e WHERE early),
 k AS (SELECT key, count(*) FILTER (WHERE early) AS a, count(*) FILTER (WHERE NOT early) AS b, max(ms) FILTER (WHERE early) AS last, arg_max(value, (ts, value)) AS value FROM e GROUP BY key)
 SELECT key, CASE WHEN b = 0 THEN a WHEN last IS NULL OR last + {_TTL * 1000} < mark THEN b ELSE a + b END AS accesses, round(value, 6) AS value FROM k, m""",
)
def stream_ttl(spark: SparkSession, sf: str) -> DataFrame:
    """Entries that nobody set for half a day are forgotten between two runs, and count from one again."""
    latest = lambda s: W.latest_entries(s.select(F.col("user_id").alias("key"), "value", "ts"), _TTL)
    out = _resumed(spark, sf, ["ts < timestamp '2024-01-20'", "ts >= timestamp '2024-01-20'"], latest)
    return out.groupBy("key").agg(F.max_by("accesses", "batch").alias("accesses"), F.round(F.max_by("value", "batch"), 6).alias("value"))


@query("stream_tail", " SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS run, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_tail(spark: SparkSession, sf: str) -> DataFrame:
    """A source that grows: each run reads what came since the one before."""
    out = _resumed(spark, sf, ["event_id % 3 = 0", "event_id % 3 <> 0"], lambda s: s.select("event_id", "value"))
    return out.groupBy("run").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("stream_batches", " SELECT count(*) AS n, round(sum(value), 4) AS total FROM events")
def stream_batches(spark: SparkSession, sf: str) -> DataFrame:
    """An asynchronous writer: batches land as files, and the whole is what was sent."""
    folder = shared_folder(spark, "streams")

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/part={n}")

    W.micro_batches(_stream(spark, sf), f"{folder}/state", write, every=None).awaitTermination()
    return cut(spark.read.parquet(f"{folder}/out").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")))
