"""Half precision, chunk filters, keyed baselines, time stamps and seeded lanes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, vectors
from ..operators import arrays as A
from .base import events, memory, query, table
from .base import vectors as vector_rows

KEY = b"a key for tests of baselines"


def _hmac_sql() -> str:
    own = KEY.ljust(64, b"\0")
    i, o = (bytes(b ^ x for b in own).hex() for x in (0x36, 0x5C))
    return f" SELECT doc_id, sha256(unhex('{o}') || unhex(sha256(unhex('{i}') || encode(text)))) AS tag, doc_id % 7 <> 0 AS verified FROM documents"


@query("hmac_baseline", _hmac_sql())
def hmac_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """A keyed tag of each chunk, and whether the chunk as it is now still has it."""
    d = table(spark, sf, "documents")
    tag = codecs.hmac_sha256(F.encode("text", "UTF-8"), KEY)
    now = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return d.select("doc_id", tag.alias("tag"), (codecs.hmac_sha256(F.encode(now, "UTF-8"), KEY) == tag).alias("verified"))


_HALF = "CASE WHEN x = 0 THEN 0 ELSE round_even(x / pow(2.0::DOUBLE, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2.0::DOUBLE, greatest(floor(log2(abs(x))), -14) - 10) END"


@query(
    "half_cosine",
    f""", h AS (SELECT vec_id, label, v, list_transform(v, lambda x: {_HALF}) AS hv FROM v_vec), q AS (SELECT v AS q, hv AS hq FROM h WHERE vec_id = 1)
 SELECT vec_id, round(list_cosine_similarity(hv, hq), 6) AS half, round(list_sum(list_transform(list_zip(v, hv), lambda p: abs(p[1] - p[2]))), 6) AS lost FROM h, q""",
    "v_vec",
)
def half_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of vectors stored in half precision with one of them, and what the storage loses."""
    h = vector_rows(spark, sf).withColumn("h", F.transform("embedding", codecs.half))
    q = [float(x) for x in h.where("vec_id = 1").first()["h"]]
    lost = F.aggregate(F.zip_with("embedding", "h", lambda a, b: F.abs(a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    return h.select("vec_id", F.round(vectors.cosine(F.col("h"), vectors.literal(q)), 6).alias("half"), F.round(lost, 6).alias("lost"))


CHUNK = 1000


@query("chunk_filters", " SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders")
def chunk_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Prices through the filters and back: chunks of orders are packed, shuffled, deflated and sealed, then read again."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    chunks = o.groupBy(F.floor(F.col("o_orderkey") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("rows"))
    chunks = chunks.select(F.transform("rows", lambda r: r["o_orderkey"]).alias("ids"), F.transform("rows", lambda r: r["o_totalprice"]).alias("values"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = [codecs.encode_chunk(np.array(v, np.float64), 2) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bodies, pa.binary())], names=["ids", "body"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).flatten()
            values = [codecs.decode_chunk(body, len(i), 2) for i, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(values or [np.zeros(0)]))], names=["o_orderkey", "price"])

    stored = chunks.mapInArrow(encode, "ids array<long>, body binary")
    return stored.mapInArrow(decode, "o_orderkey long, price double").withColumn("price", F.round("price", 2))


@query("iso_time", " SELECT event_id, strftime(make_timestamp(CAST(floor(timestamp) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS iso, extract(year FROM make_timestamp(CAST(floor(timestamp) AS BIGINT) * 1000000)) % 4 = 0 AS leap FROM v_event", "v_event")
def iso_time(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds since 1970 as ISO 8601 in UTC, whatever the session's time zone."""
    e = events(spark, sf).select("event_id", F.floor("timestamp").alias("s"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("s") / 86400).cast("int"))
    clock = [F.lpad(F.floor(F.pmod("s", F.lit(86400)) / n % m).cast("string"), 2, "0") for n, m in ((3600, 24), (60, 60), (1, 60))]
    year = F.year(day)
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return e.select("event_id", F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), F.concat_ws(":", *clock), F.lit("Z")).alias("iso"), leap.alias("leap"))


def _lane_sql(seed: int, lanes: int) -> str:
    k, m = "5871781006564002453::UHUGEINT", "18446744073709551616::UHUGEINT"

    def fx(x: str) -> str:
        a = f"(({x}) * {k} % {m})"
        b = f"(xor({a}, {a} // 8589934592::UHUGEINT) * {k} % {m})"
        return f"xor({b}, {b} // 536870912::UHUGEINT)"

    return f", a AS (SELECT mem_id, {fx('mem_id::UHUGEINT')} AS h FROM v_memory), b AS (SELECT mem_id, xor(h, {seed}::UHUGEINT) AS x FROM a) SELECT mem_id, CAST({fx('x')} % {lanes} AS INT) AS lane FROM b"


@query("hash_lanes", _lane_sql(42, 8), "v_memory")
def hash_lanes(spark: SparkSession, sf: str) -> DataFrame:
    return A.hash_lanes(memory(spark, sf).select("mem_id"), "mem_id", 8, 42).select("mem_id", "lane")
