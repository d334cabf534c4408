"""Content integrity: recorded hashes, checksums and Merkle trees."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashes

PAD = hashlib.sha256(hashes.PAD_INPUT).hexdigest()


def merkle_levels(leaves: DataFrame) -> list[DataFrame]:
    """``(i, h)`` for each level of ``leaves(i, text)``, leaves first. Padding fills the leaves up to a power of two.

    A level is an aggregate by half the index; whole subtrees of padding are one constant for each level.
    """
    level = leaves.select("i", hashes.leaf_hash(F.col("text")).alias("h"))
    n = leaves.agg(F.max("i")).first()[0]
    if n is None:
        return []
    n, pad, out = n + 1, PAD, [level]
    while n > 1:
        pair = level.groupBy(F.floor(F.col("i") / 2).cast("long").alias("i")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("h"))).alias("a"), F.max(F.when(F.col("i") % 2 == 1, F.col("h"))).alias("b"))
        level = pair.select("i", hashes.node_hash(F.coalesce("a", F.lit(pad)), F.coalesce("b", F.lit(pad))).alias("h"))
        pad = hashlib.sha256(bytes.fromhex("01" + pad + pad)).hexdigest()
        n = (n + 1) // 2
        out.append(level)
    return out


def pads(levels: int) -> list[str]:
    out = [PAD]
    for _ in range(levels):
        out.append(hashlib.sha256(bytes.fromhex("01" + out[-1] * 2)).hexdigest())
    return out


def merkle_proof(levels: list[DataFrame], index: int) -> list[str]:
    """The sibling of each level on the way from a leaf to the root."""
    fill = pads(len(levels))
    out = []
    for k, level in enumerate(levels[:-1]):
        sibling = (index >> k) ^ 1
        row = level.where(F.col("i") == sibling).first()
        out.append(row["h"] if row else fill[k])
    return out


def merkle_proofs(levels: list[DataFrame], leaves: DataFrame) -> DataFrame:
    """``leaves(i, text)`` with ``proof``: for each level the sibling's hash ``h``, and whether it stands to the ``left``.

    A level is one join by index, whatever the number of leaves.
    """
    fill = pads(len(levels))
    out = leaves.withColumn("proof", F.array().cast("array<struct<left: boolean, h: string>>"))
    for k, level in enumerate(levels[:-1]):
        at = F.floor(F.col("i") / (1 << k)).cast("long")
        out = out.withColumns({"_left": at % 2 == 1, "_at": F.when(at % 2 == 1, at - 1).otherwise(at + 1)})
        out = out.join(level.select(F.col("i").alias("_at"), F.col("h").alias("_h")), "_at", "left")
        step = F.struct(F.col("_left").alias("left"), F.coalesce("_h", F.lit(fill[k])).alias("h"))
        out = out.withColumn("proof", F.concat("proof", F.array(step))).drop("_at", "_left", "_h")
    return out


def proven_root(text: Column, proof: Column) -> Column:
    """The root that a text and its ``proof`` lead to."""
    return F.aggregate(proof, hashes.leaf_hash(text), lambda h, s: hashes.node_hash(F.when(s["left"], s["h"]).otherwise(h), F.when(s["left"], h).otherwise(s["h"])))


def verify_proof(text: str, index: int, proof: list[str], root: str) -> bool:
    h = hashlib.sha256(b"\x00" + text.encode()).digest()
    for k, s in enumerate(proof):
        other = bytes.fromhex(s)
        h = hashlib.sha256(b"\x01" + (other + h if index >> k & 1 else h + other)).digest()
    return h.hex() == root
