"""Hashes and proofs over documents and test items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashes
from ..operators import integrity as I
from .base import query, table


@query("sha256_verify", " SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'NoHash' WHEN doc_id % 7 = 0 THEN 'Mismatch' ELSE 'Ok' END AS status, sha256(text) AS digest FROM documents")
def sha256_verify(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    recorded = F.when(F.col("doc_id") % 5 != 0, F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256)))
    return d.select("doc_id", hashes.sha256_status(F.col("text"), recorded).alias("status"), F.sha2("text", 256).alias("digest"))


_FNV = """, b AS (SELECT item_id, hex(encode(text)) AS x FROM benchmark),
 f(item_id, x, i, h) AS (SELECT item_id, x, 0, 14695981039346656037::UHUGEINT FROM b
   UNION ALL SELECT item_id, x, i + 1, (xor(h, ('0x' || x[i * 2 + 1:i * 2 + 2])::INT::UHUGEINT) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT FROM f WHERE i * 2 < length(x))
 SELECT item_id, printf('%016x', h::UBIGINT) AS fnv FROM f WHERE i * 2 = length(x)"""


@query("fnv1a", _FNV)
def fnv1a(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", hashes.fnv1a64(F.col("text")).alias("fnv"))


@query("provenance_verify", _FNV.replace("SELECT item_id, printf", "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN false ELSE true END AS verified, printf"))
def provenance_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose content still has the hash they were stored with."""
    b = table(spark, sf, "benchmark").withColumn("fnv", hashes.fnv1a64_fast(F.col("text")))
    stored = F.when(F.col("item_id") % 3 == 0, F.lit("0" * 16)).otherwise(hashes.fnv1a64(F.col("text")))
    return b.select("item_id", (stored == F.col("fnv")).alias("verified"), "fnv")


_CRC = """, b AS (SELECT item_id, hex(encode(text)) AS x FROM benchmark), b2 AS (SELECT item_id, x || CASE WHEN length(x) % 4 = 2 THEN '00' ELSE '' END AS x FROM b),
 bits(i, k, c) AS (SELECT range, 0, range::UBIGINT FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END FROM bits WHERE k < 8),
 tab AS MATERIALIZED (SELECT i AS ti, c AS tc FROM bits WHERE k = 8),
 cr(item_id, x, i, c) AS (SELECT item_id, x, 0, 4294967295::UBIGINT FROM b UNION ALL SELECT item_id, x, i + 1, xor(c // 256, tc) FROM cr JOIN tab ON ti = xor(c % 256, ('0x' || x[i * 2 + 1:i * 2 + 2])::INT::UBIGINT) WHERE i * 2 < length(x)),
 fl(item_id, x, i, p, q) AS (SELECT item_id, x, 0, 0::BIGINT, 0::BIGINT FROM b2 UNION ALL SELECT item_id, x, i + 1, (p + ('0x' || x[i * 4 + 1:i * 4 + 4])::INT) % 65535, (q + (p + ('0x' || x[i * 4 + 1:i * 4 + 4])::INT) % 65535) % 65535 FROM fl WHERE i * 4 < length(x))
 SELECT cr.item_id, CAST(xor(c, 4294967295::UBIGINT) AS BIGINT) AS crc, q * 65536 + p AS fletcher FROM cr JOIN fl ON cr.item_id = fl.item_id WHERE cr.i * 2 = length(cr.x) AND fl.i * 4 = length(fl.x)"""


@query("crc32", _CRC)
def crc32(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.crc32(F.encode("text", "UTF-8")).alias("crc"), hashes.fletcher32(F.encode("text", "UTF-8")).alias("fletcher"))


@query("lookup3")
def lookup3(spark: SparkSession, sf: str) -> DataFrame:
    """Tests hold it against known values."""
    return table(spark, sf, "benchmark").select("item_id", hashes.lookup3(F.encode("text", "UTF-8")).alias("lookup3"))


def _leaves(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("i"), "text")


def _merkle_sql(levels: int) -> str:
    pad = I.pads(levels)
    out = ", l0 AS (SELECT item_id AS i, sha256('\\x00'::BLOB || encode(text)) AS h FROM benchmark)"
    for k in range(levels):
        out += f", l{k + 1} AS (SELECT i // 2 AS i, sha256(unhex('01' || coalesce(max(h) FILTER (WHERE i % 2 = 0), '{pad[k]}') || coalesce(max(h) FILTER (WHERE i % 2 = 1), '{pad[k]}'))) AS h FROM l{k} GROUP BY i // 2)"
    return out


@query("merkle_levels", _merkle_sql(12) + " SELECT level, i, h FROM (" + " UNION ALL ".join(f"SELECT {k} AS level, i, h FROM l{k}" for k in range(13)) + ") WHERE level <= ceil(log2((SELECT max(item_id) + 1 FROM benchmark)))")
def merkle_levels(spark: SparkSession, sf: str) -> DataFrame:
    """All levels of the tree over the test items."""
    out = None
    for k, level in enumerate(I.merkle_levels(_leaves(spark, sf))):
        one = level.select(F.lit(k).alias("level"), "i", "h")
        out = one if out is None else out.unionByName(one)
    return out


@query("merkle_root", _merkle_sql(8) + " SELECT CASE WHEN (SELECT max(item_id) FROM benchmark) < 64 THEN (SELECT h FROM l6 WHERE i = 0) ELSE (SELECT h FROM l8 WHERE i = 0) END AS root")
def merkle_root(spark: SparkSession, sf: str) -> DataFrame:
    return I.merkle_levels(_leaves(spark, sf))[-1].select(F.col("h").alias("root"))


@query("merkle_proof", " SELECT item_id AS i, CAST(ceil(log2((SELECT max(item_id) + 1 FROM benchmark))) AS INT) AS steps, true AS valid, false AS forged FROM benchmark")
def merkle_proof(spark: SparkSession, sf: str) -> DataFrame:
    """Proofs of all leaves against the root."""
    levels = I.merkle_levels(_leaves(spark, sf))
    root = levels[-1].first()["h"]
    p = I.merkle_proofs(levels, _leaves(spark, sf))
    forged = F.concat("text", F.lit("!"))
    return p.select("i", F.size("proof").alias("steps"), (I.proven_root(F.col("text"), F.col("proof")) == root).alias("valid"), (I.proven_root(forged, F.col("proof")) == root).alias("forged"))
