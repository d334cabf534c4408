"""Line dedup by a log-template tree of fixed depth.

A line goes to a leaf by its number of tokens and its leading tokens (tokens with a digit are variable and look alike). Within a
leaf, a line joins the template that it shares most places with, if these are enough; a place where members of a template differ
is a variable field of all of them. Otherwise it begins a template. A template that recurs across documents is dropped from all
but the first of them.

Lines travel as two hashes. Their text is read again only for leaves that two documents share and that hold different lines.
How common a line is doesn't matter, as lines are distinct before they meet. The distinct lines of a leaf pass through a task in the order
of their first documents, and the task holds their templates only. A leaf of more than SHARD lines is dealt by hash into shards of
about so many, each with templates of its own; these then join each other by the same rule, again in the order of first documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import give_back, materialize

DEPTH = 3
MIN_TOKENS = 3
#: ``min_tokens`` with which short lines are told apart by their whole text and only blank ones stay.
EVERY_LINE = 1
CONSTANT = 0.7
#: Distinct lines of a leaf that pass through one task, about.
SHARD = 8192
WILD = "<*>"
_ANY = -1
#: Bits of the filter of leaves that is sent to the tasks, whatever their number: 4 MB.
FILTER_BITS = 25
_DIGIT = re.compile(r"[0-9]")


def masked(line: str) -> list[str]:
    """Tokens of a line, lower-cased, those with a digit as a wild card."""
    tokens = line.lower().split()
    if _DIGIT.search(line):
        tokens = [WILD if _DIGIT.search(t) else t for t in tokens]
    return tokens


def _signed(data: bytes, seed: int = 0) -> int:
    x = xxhash.xxh64_intdigest(data, seed)
    return x - (1 << 64) if x >> 63 else x


def keys(tokens: list[str], depth: int) -> tuple[int, int, str]:
    """``(leaf, h, text)`` of masked tokens."""
    text = " ".join(tokens)
    lead = " ".join(tokens[:depth])
    return _signed(f"{len(tokens)} {lead}".encode("utf-8", "replace")), _signed(text.encode("utf-8", "replace")), text


#: What stands for a null doc_id: rows without one are one document behind all others.
NAMELESS = (1 << 63) - 1
_DOC, _HASH, _GONE = "lines_doc_", "lines_hash_", "lines_gone_"


def _own(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NAMELESS)).alias("doc_id"), F.col("text").cast("string").alias("text"))


def hashed_lines(docs: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """``(doc_id, th, nth, leaf, h)`` of every line with enough tokens; th is a hash of the whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"].tolist(), b["text"], strict=True):
                th = _signed(text.encode("utf-8", "replace"), 42)  # as Spark's xxhash64 has it
                for nth, line in enumerate(text.split("\n")):
                    tokens = masked(line)
                    if len(tokens) >= min_tokens:
                        leaf, h, _ = keys(tokens, depth)
                        out.append((doc_id, th, nth, leaf, h))
            if out:
                yield pd.DataFrame(np.array(out, np.int64), columns=["doc_id", "th", "nth", "leaf", "h"])
        give_back()

    return _own(docs).mapInPandas(run, "doc_id long, th long, nth long, leaf long, h long")


def _filter_of(leaves: DataFrame) -> np.ndarray:
    """A bitmap of hashed leaves, of one size for any number of them."""
    at = F.pmod(F.col("leaf"), F.lit(1 << FILTER_BITS))
    blocks = leaves.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    bits = np.zeros((1 << FILTER_BITS) // 8 + 4096, np.uint8)
    for r in blocks.collect():  # a row for each block of 4 KB: at most 1,025 of them
        start = (r["bucket"] - 1) * 4096 if r["bucket"] > 0 else 0
        own = np.frombuffer(bytes(r["bits"]), np.uint8)
        bits[start : start + len(own)] |= own
    return bits


def texts_of(docs: DataFrame, leaves: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """``(leaf, h, m)``, distinct: the masked lines of ``leaves``."""
    sent = docs.sparkSession.sparkContext.broadcast(_filter_of(leaves))
    size = 1 << FILTER_BITS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = sent.value
        for b in batches:
            out = set()
            for text in b["text"]:
                for line in text.split("\n"):
                    tokens = masked(line)
                    if len(tokens) >= min_tokens:
                        leaf, h, m = keys(tokens, depth)
                        # the aggregate counts positions from 1 within blocks of 32768 bits
                        at = leaf % size
                        if _bit(bits, at):
                            out.add((leaf, h, m))
            if out:
                yield pd.DataFrame(sorted(out), columns=["leaf", "h", "m"])
        give_back()

    found = _own(docs).select("text").mapInPandas(run, "leaf long, h long, m string")
    return found.join(leaves, "leaf", "left_semi").distinct()


def _bit(bits: np.ndarray, at: int) -> bool:
    """Whether the bitmap aggregates put a bit for ``at``: bucket 1 + (at - 1) // 32768, position (at - 1) % 32768; 0 has bucket 0."""
    if at == 0:
        return True  # its block is shared with the first one; a filter may say yes too often
    k = at - 1
    return bool(bits[k >> 3] >> (k & 7) & 1)


class Leaf:
    """Templates of one leaf, in the order in which their first lines came."""

    def __init__(self, n: int, depth: int, constant: float) -> None:
        self.n, self.depth = n, min(depth, n)
        self.least = math.ceil(constant * n - 1e-9)
        self.ids: dict[str, int] = {WILD: _ANY}
        self.words = [WILD]
        self.rows = np.empty((4, n), np.int64)
        self.size = 0
        self.at: dict[tuple[int, bytes], list[int]] = {}
        self.blocks: list[tuple[int, int]] | None = None

    def _keys(self, x: np.ndarray) -> list[tuple[int, bytes]]:
        """Pieces of a line behind the leading tokens: a template that is similar enough is equal in at least one of them."""
        if self.blocks is None:
            spare = self.n - self.least - int((x[: self.depth] == _ANY).sum())
            tail = self.n - self.depth
            cuts = [self.depth + tail * k // (spare + 1) for k in range(spare + 2)] if 0 <= spare < tail else []
            self.blocks = list(zip(cuts, cuts[1:], strict=False))
        return [(lo, x[lo:hi].tobytes()) for lo, hi in self.blocks if (x[lo:hi] != _ANY).all()]

    def add(self, tokens: list[str]) -> int:
        """The template of the next line."""
        for t in tokens:
            if t not in self.ids:
                self.ids[t] = len(self.words)
                self.words.append(t)
        x = np.array([self.ids[t] for t in tokens], np.int64)
        able = int((x != _ANY).sum()) >= self.least
        found = self._keys(x) if able else []
        if able and self.size:
            if self.blocks:
                near = np.array(sorted({i for k in found for i in self.at.get(k, ())}), np.int64)
            else:
                near = np.arange(self.size)
            if len(near):
                same = ((self.rows[near] == x) & (x != _ANY)).sum(axis=1)
                best = int(same.argmax())
                if same[best] >= self.least:
                    row = self.rows[near[best]]
                    row[row != x] = _ANY
                    return int(near[best])
        if self.size == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[self.size] = x
        for k in found:
            self.at.setdefault(k, []).append(self.size)
        self.size += 1
        return self.size - 1

    def text(self, template: int) -> str:
        return " ".join(WILD if i == _ANY else self.words[i] for i in self.rows[template].tolist())


def templates(texts: DataFrame, depth: int, constant: float, shard: int = SHARD) -> DataFrame:
    """``(leaf, h, lo, hi, template)`` of distinct lines ``texts(leaf, h, m, lo, hi)``; template names one within the leaf."""
    sizes = texts.groupBy("leaf").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    dealt = texts.join(sizes, "leaf").withColumn("part", F.pmod("h", F.col("shards")).cast("int"))
    named = _clusters(dealt.select("leaf", "part", "shards", "h", "m", "lo", "hi"), depth, constant)
    one = named.where("m is null and shards = 1").select("leaf", "h", "lo", "hi", F.struct("part", "template").alias("template"))
    several = materialize(named.where("shards > 1"), "templates")
    # templates of shards as lines: those of a leaf stay apart in (part, template) until they have joined
    again = several.where("m is not null").select("leaf", F.lit(0).alias("part"), F.lit(1).alias("shards"), F.struct("part", "template").alias("own"), "m", "lo", "hi")
    again = again.withColumn("h", F.col("own.part").cast("long") * (1 << 32) + F.col("own.template"))
    joined = _clusters(again.drop("own"), depth, constant).select("leaf", F.floor(F.col("h") / (1 << 32)).cast("int").alias("part"), F.pmod("h", F.lit(1 << 32)).alias("template"), F.col("template").alias("by"))
    rest = several.where("m is null").join(joined, ["leaf", "part", "template"])
    return one.unionByName(rest.select("leaf", "h", "lo", "hi", F.struct(F.lit(0).alias("part"), F.col("by").alias("template")).alias("template")))


def _clusters(lines: DataFrame, depth: int, constant: float) -> DataFrame:
    """Lines ``(leaf, part, shards, h, m, lo, hi)`` with the number of their template in their part, and m null.

    Where a leaf has several shards, also a row for each template, with its text in m and its first document in lo.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, own, first, several = None, None, [], False

        def ended() -> Iterator[pd.DataFrame]:
            if several:
                n = range(own.size)
                yield pd.DataFrame({"leaf": held[0], "part": held[1], "shards": 2, "h": 0, "lo": first, "hi": first, "template": n, "m": [own.text(k) for k in n]}, columns=columns)

        for b in batches:
            out, at = [], 0
            leaves, parts, shards, los = (b[k].tolist() for k in ("leaf", "part", "shards", "lo"))
            for i, m in enumerate(b["m"]):
                tokens = m.split(" ")
                if (leaves[i], parts[i]) != held:
                    if several:
                        yield b.iloc[at:i].assign(template=out, m=None)[columns]
                        out, at = [], i
                        yield from ended()
                    held, own, first, several = (leaves[i], parts[i]), Leaf(len(tokens), depth, constant), [], shards[i] > 1
                out.append(own.add(tokens))
                if several and out[-1] == len(first):
                    first.append(los[i])
            yield b.iloc[at:].assign(template=out, m=None)[columns]
        yield from ended()
        give_back()

    columns = ["leaf", "part", "shards", "h", "lo", "hi", "template", "m"]
    # a given number: what a line costs in Python isn't seen by its bytes, by which partitions would be joined
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.repartition(n, "leaf", "part").sortWithinPartitions("leaf", "part", "lo", "h")
    return dealt.mapInPandas(run, "leaf long, part int, shards int, h long, lo long, hi long, template long, m string")


def recurring(docs: DataFrame, lines: DataFrame, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, constant: float = CONSTANT, shard: int = SHARD) -> DataFrame:
    """``(leaf, h, first_doc)`` of lines whose template stands in at least two documents, from ``hashed_lines``."""
    stats = lines.groupBy("leaf", "h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    leaves = stats.groupBy("leaf").agg(F.min("lo").alias("first"), F.max("hi").alias("last"), F.min("h").alias("a"), F.max("h").alias("b")).where("first < last")
    leaves = materialize(leaves, "leaves")
    same = leaves.where("a = b").select("leaf", F.col("a").alias("h"), F.col("first").alias("first_doc"))
    several = leaves.where("a < b").select("leaf")
    texts = materialize(texts_of(docs, several, depth, min_tokens), "texts")
    named = materialize(templates(texts.join(stats.join(several, "leaf", "left_semi"), ["leaf", "h"]), depth, constant, shard), "named")
    across = named.groupBy("leaf", "template").agg(F.min("lo").alias("first_doc"), F.max("hi").alias("last")).where("first_doc < last").drop("last")
    return same.unionByName(named.join(across, ["leaf", "template"]).select("leaf", "h", "first_doc"))


def drop_recurring(docs: DataFrame, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, constant: float = CONSTANT, counts: tuple[str, str] | None = ("n_lines", "n_dropped"), shard: int = SHARD) -> DataFrame:
    """``docs`` with the lines that are kept, and the numbers of all and of dropped lines in two columns named ``counts``.

    A line goes if its template recurs across documents and this isn't the first of them (by doc_id); within the first one it
    stays however often it stands there. Lines of fewer than ``min_tokens`` tokens stay. Null text stays null. Rows repeated under a doc_id are
    one document, and so are all rows without one, which stands behind all others. A document may be left
    with an empty text. Other columns stay; a column that has a name of ``counts`` is replaced, and with None there are no counts.
    """
    lines = materialize(hashed_lines(docs, depth, min_tokens), "lines")
    found = recurring(docs, lines, depth, min_tokens, constant, shard)
    hit = lines.join(found, ["leaf", "h"]).where("doc_id <> first_doc")
    gone = hit.groupBy(F.col("doc_id").alias(_DOC), F.col("th").alias(_HASH)).agg(F.collect_set(F.col("nth").cast("int")).alias("at"))

    def flags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            masks = []
            for at in b["at"]:
                own = np.zeros(int(max(at)) + 1, bool)
                own[np.asarray(at, np.int64)] = True
                masks.append(own)
            yield b[[_DOC, _HASH]].assign(**{_GONE: masks})
        give_back()

    gone = gone.mapInPandas(flags, f"{_DOC} long, {_HASH} long, {_GONE} array<boolean>")
    text = F.col("text").cast("string")
    at = docs.withColumns({_DOC: F.coalesce(F.col("doc_id").cast("long"), F.lit(NAMELESS)), _HASH: F.xxhash64(text)})
    at = at.join(gone, [_DOC, _HASH], "left").drop(_DOC, _HASH)
    left = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.coalesce(F.get(_GONE, i), F.lit(False)))
    kept = {"text": F.when(F.col(_GONE).isNull(), text).otherwise(F.array_join(left, "\n"))}
    if counts:
        n = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
        lost = F.when(F.col(_GONE).isNull(), 0).otherwise(F.size(F.filter(_GONE, lambda x: x)))
        kept = {counts[0]: n, counts[1]: lost} | kept
    return at.withColumns(kept).drop(_GONE)


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import table

    found = drop_recurring(table(spark, sf_dir, "documents"), min_tokens=EVERY_LINE)
    return found.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), "text")
