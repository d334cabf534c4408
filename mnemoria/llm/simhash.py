"""SimHash near-dedup: fingerprints of word shingles, and BK-trees to find those within a few bits.

Equal fingerprints are one node. Of ``bits + 1`` blocks of the 64 bits, two fingerprints within ``bits`` share at least
one, so each block's value names a bucket in which a BK-tree is built and searched: the blocks do most of the pruning, and a tree
what is left of it in its bucket. One tree over all fingerprints would have to be sent to every task. A bucket of more than
``shard`` fingerprints is dealt into shards: every shard's tree meets the queries of every shard, each such
pair of bounded size in its own group, so near copies by the thousand neither land in one task nor lose a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, materialize, over_groups, over_texts, union_find

SEED = 42
BITS = 2
SHARD = 1024
#: Names of columns that no table has.
ROW, ID = "simhash_row_", "simhash_id_"


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit SimHash of the shingles of ``text``; 0 for a text without words."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and \x20 \x09-\x0D only
    if not w:
        return 0
    if len(w) <= words:
        return _majority([xxhash.xxh64_intdigest(b" ".join(w), SEED)])
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    h, seed = xxhash.xxh64_intdigest, SEED
    return _majority([h(joined[a:b], seed) for a, b in zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)])


def _majority(hashes: list[int]) -> int:
    own = np.array(hashes, dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(own), 32768):  # a slice of a very long text at a time
        ones += np.unpackbits(own[at : at + 32768].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(own)).tobytes(), "big")


class BKTree:
    """Children are keyed by their integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self.value: list[int] = []
        self.name: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int, name: int) -> None:
        self.value.append(value)
        self.name.append(name)
        self.children.append({})
        new = len(self.value) - 1
        at = 0
        while at != new:
            d = (value ^ self.value[at]).bit_count()
            at = self.children[at].setdefault(d, new)

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Names of values at most ``radius`` away; only edges within the radius of the own distance are followed."""
        todo = [0] if self.value else []
        while todo:
            at = todo.pop()
            d = (value ^ self.value[at]).bit_count()
            if d <= radius:
                yield self.name[at]
            kids = self.children[at]
            if len(kids) > 2 * radius + 1:
                todo.extend(kids[e] for e in range(d - radius, d + radius + 1) if e in kids)
            else:
                todo.extend(k for e, k in kids.items() if d - radius <= e <= d + radius)


def fingerprints(docs: DataFrame, words: int = 3, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(*keys, fp)``: fp is the fingerprint's bits as a signed long. Texts are whole; null is a text without words."""

    def make():  # noqa: ANN202
        return lambda texts: (None, [np.fromiter((fingerprint(t, words) for t in texts), np.uint64, len(texts)).view(np.int64)])

    return over_texts(docs, make, "fp long", keys)


def near_pairs(nodes: DataFrame, bits: int = BITS, shard: int = SHARD) -> DataFrame:
    """Edges ``(u, v)`` between ``nodes(node, fp)`` (fp unique), enough to join all that differ in ``bits`` bits or fewer.

    A group that finds many links returns a spanning forest of them: what is linked stays so, and the
    number of rows is in proportion to the nodes, however dense a group of near copies is.
    """
    cuts = np.linspace(0, 64, bits + 2).round().astype(int).tolist()
    keys = F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value")) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))])
    each = nodes.select("node", "fp", F.explode(keys).alias("k")).select("node", "fp", "k.block", "k.value")
    sizes = each.groupBy("block", "value").agg(F.count("*").alias("n")).where("n > 1")
    each = each.join(sizes, ["block", "value"]).withColumn("shards", F.ceil(F.col("n") / shard).cast("int"))
    each = each.withColumn("own", F.when(F.col("shards") > 1, F.pmod(F.xxhash64("node"), F.col("shards"))).otherwise(0).cast("int"))
    # each shard's tree (tree >= query) meets the queries of the shards up to it; a shard plays both parts in its own group
    other = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("other")
    dealt = each.select("block", "value", "node", "fp", "own", other)
    dealt = dealt.select("block", "value", F.greatest("own", "other").alias("tree"), F.least("own", "other").alias("query"), "node", "fp", "own")

    def search(key: tuple, g: pd.DataFrame) -> pd.DataFrame | None:
        tree, query = key[2], key[3]
        values, names, own = g["fp"].to_numpy().view(np.uint64).tolist(), g["node"].tolist(), g["own"].tolist()
        t = BKTree()
        found: list[tuple[int, int]] = []
        if tree == query:
            for v, x in zip(values, names, strict=True):
                found.extend((x, y) for y in t.within(v, bits))
                t.add(v, x)
        else:
            for v, x, o in zip(values, names, own, strict=True):
                if o == tree:
                    t.add(v, x)
            for v, x, o in zip(values, names, own, strict=True):
                if o == query:
                    found.extend((x, y) for y in t.within(v, bits))
                    if len(found) > 100_000:
                        found = [(a, r) for a, r in union_find(found).items() if a != r]
        if len(found) > len(values):
            found = [(a, r) for a, r in union_find(found).items() if a != r]
        return pd.DataFrame(found, columns=["u", "v"]) if found else None

    return over_groups(dealt, ["block", "value", "tree", "query"], search, "u long, v long", ["node"])


def classes(fps: DataFrame, bits: int = BITS, shard: int = SHARD) -> DataFrame:
    """``(fp, class)`` of the distinct ``fps.fp``: the same number for all that links of ``bits`` bits or fewer join."""
    nodes = materialize(fps.groupBy("fp").agg(F.first("fp").alias("node")), "nodes")
    found = components(near_pairs(nodes, bits, shard))
    return nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("class"))


def near_duplicates(docs: DataFrame, bits: int = BITS, words: int = 3, shard: int = SHARD) -> DataFrame:
    """``(doc_id, fp, component_id)``; component_id is the smallest doc_id reachable over links of ``bits`` bits or fewer.

    A row for each row of ``docs``: repeated rows stay. Texts without words have fingerprint zero and are linked by it like any
    other. Rows without a doc_id link like others and name no component: where a component has no id, component_id is null.
    """
    fps = materialize(fingerprints(docs, words), "fingerprints")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(classes(fps, bits, shard), "fp")
    least = materialize(least, "classes")
    named = least.groupBy("class").agg(F.min("least").alias("component_id"))
    return fps.join(least.join(named, "class").select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, bits: int = BITS, words: int = 3, shard: int = SHARD) -> DataFrame:
    """``docs`` without near duplicates: one row of each component stays, that with the smallest doc_id, rows without one last.

    Rows are judged, not ids: under one doc_id two different texts are two rows, of which the one with the smaller hash comes first. Rows equal in
    doc_id and text are one, and one of them stays, with the other columns of any.
    """
    own = docs.select("*", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias(ROW))
    fps = materialize(fingerprints(own, words, ("doc_id", ROW)), "fingerprints")
    one = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ROW)).alias("one"))
    one = one.join(classes(fps, bits, shard), "fp").groupBy("class").agg(F.min("one").alias("one"))
    # (id, hash): hashes meet only under one id; for null ids, 0 stands beside their hash
    kept = one.select(F.coalesce("one.doc_id", F.lit(0)).alias(ID), F.col(f"one.{ROW}").alias(ROW)).distinct()
    joined = own.withColumn(ID, F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).join(kept, [ID, ROW], "left_semi")
    return joined.dropDuplicates([ID, ROW]).select(*docs.columns)
