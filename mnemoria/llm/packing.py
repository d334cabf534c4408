"""Best-fit packing after Martello-Toth dominance reduction, on the histogram of piece lengths.

How pieces of one length are told apart doesn't matter to a packing, so the instance is the histogram: at most
``capacity`` numbers, whatever the corpus holds. It is solved once on the driver; pieces then find their
place from their rank within their length. No piece, and no list of pieces, ever reaches the driver.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import give_back, materialize, over_texts
from .tokens import ids_of

CAPACITY = 4096


class _Lengths:
    """A multiset of lengths with ordered look-up."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.n = {w: c for w, c in counts.items() if c}
        self.keys = sorted(self.n)

    def take(self, w: int, k: int) -> None:
        self.n[w] -= k
        if not self.n[w]:
            del self.n[w]
            del self.keys[bisect.bisect_left(self.keys, w)]

    def largest(self, most: int) -> int | None:
        i = bisect.bisect_right(self.keys, most)
        return self.keys[i - 1] if i else None

    def but(self, w: int) -> Callable[[int], int]:
        """Counts beside one piece of length ``w``."""
        return lambda x: self.n.get(x, 0) - (x == w)

    def shortest(self, w: int, k: int, above: int = 0) -> list[int]:
        """The ``k`` shortest that are longer than ``above``, or fewer, beside one piece of length ``w``."""
        own, out = self.but(w), []
        for x in self.keys[bisect.bisect_right(self.keys, above) :]:
            out += [x] * min(own(x), k - len(out))
            if len(out) == k:
                break
        return out

    def longest(self, w: int, most: int) -> int:
        """The longest of at most ``most``, beside one piece of length ``w``; one must be there."""
        best = self.largest(most)
        return best if self.but(w)(best) else self.keys[bisect.bisect_left(self.keys, best) - 1]

    def fullest_pair(self, w: int, room: int) -> tuple[int, int]:
        """The two that fill most of ``room``, the longer first, beside one piece of length ``w``; two must fit."""
        own = self.but(w)
        keys = [x for x in self.keys if own(x)]
        lo, hi, best = 0, bisect.bisect_right(keys, room) - 1, (0, 0)
        while lo <= hi:
            total = keys[lo] + keys[hi]
            if total > room or (lo == hi and own(keys[lo]) < 2):
                hi -= 1
                continue
            if total > sum(best):
                best = keys[hi], keys[lo]
            lo += 1
        return best


def _dominating(left: _Lengths, w: int, capacity: int) -> list[int] | None:
    """What stands beside a piece of length ``w`` in some optimal packing, by Martello and Toth's criterion for at most two; None if it can't tell.

    A set dominates another one if the other's pieces can be put into its places. At most two others fit wherever a rule is used.
    """
    room = capacity - w
    least = left.shortest(w, 3)
    if not least or least[0] > room:
        return []
    best = left.longest(w, room)
    if best == room or len(least) < 2 or least[0] + least[1] > room:
        return [best]
    if len(least) == 3 and sum(least) <= room:
        return None
    a, b = left.fullest_pair(w, room)
    if best >= a + b:
        return [best]
    # pairs whose shorter piece is longer than b aren't dominated; none fits if the shortest two such don't
    more = left.shortest(w, 2, b)
    return [a, b] if a == best and (len(more) < 2 or sum(more) > room) else None


def reduce(counts: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Sequences that some optimal packing has, and the counts that remain.

    From the longest piece down, and again until nothing more is fixed: a piece with nothing, one or two others that dominate every
    alternative. Each leaves an optimal packing of the rest optimal, and holds as long as the pieces last, so it is applied to
    all of them at once.
    """
    left = _Lengths(counts)
    fixed: list[tuple[dict[int, int], int]] = []
    before = -1
    while before != len(fixed):
        before = len(fixed)
        for w in list(reversed(left.keys)):
            while left.n.get(w) and (others := _dominating(left, w, capacity)) is not None:
                pattern = dict(Counter([w, *others]))
                k = min(left.n[x] // c for x, c in pattern.items())
                for x, c in pattern.items():
                    left.take(x, k * c)
                fixed.append((pattern, k))
    return fixed, dict(left.n)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's bound L2: no packing has fewer sequences.

    For each length K: pieces longer than capacity - K stand without pieces of K or more; those over half of it stand one in
    each; what is in between fills what these leave, then sequences of its own.
    """
    n = np.zeros(capacity + 2, np.int64)
    for w, c in counts.items():
        n[w] = c
    size = n * np.arange(capacity + 2)
    n_from, size_from = np.cumsum(n[::-1])[::-1], np.cumsum(size[::-1])[::-1]  # of this length or longer
    half = capacity // 2 + 1
    best = -(-int(size_from[0]) // capacity)
    for k in [0, *(w for w in counts if 2 * w <= capacity)]:
        top = max(half, capacity - k + 1)
        spare = int((n_from[half] - n_from[top]) * capacity - (size_from[half] - size_from[top]))
        best = max(best, int(n_from[half]) + max(0, -((spare - int(size_from[k] - size_from[half])) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing of a histogram: the longest first, each into the fullest sequence that still takes it.

    Sequences with the same room are kept as one entry, so the work depends on the number of lengths, not of pieces.
    """
    rooms: list[int] = []  # ascending; groups[room]: those with that room
    groups: dict[int, list[tuple[dict[int, int], int]]] = {}

    def put(room: int, what: dict[int, int], n: int) -> None:
        if room not in groups:
            bisect.insort(rooms, room)
            groups[room] = []
        groups[room].append((what, n))

    for w in sorted(counts, reverse=True):
        count = counts[w]
        while count:
            i = bisect.bisect_left(rooms, w)
            if i == len(rooms):
                k = min(capacity // w, count)
                full, over = divmod(count, k)
                put(capacity - k * w, {w: k}, full)
                if over:
                    put(capacity - over * w, {w: over}, 1)
                break
            room = rooms[i]
            what, n = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(i)
            k = min(room // w, count)
            used = min(n, count // k)
            if used < n:
                put(room, what, n - used)
            put(room - k * w, what | {w: what.get(w, 0) + k}, used)
            count -= used * k
    return [g for room in rooms for g in groups[room]]


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """``(pattern, number of sequences)``: a pattern says how many pieces of each length a sequence holds."""
    if any(not 0 < w <= capacity for w in counts):
        raise ValueError("a length is out of range")
    fixed, rest = reduce(counts, capacity)
    return fixed + best_fit(rest, capacity)


class Places:
    """From a length and the rank of a piece among those of that length to its sequence and offset."""

    def __init__(self, patterns: list[tuple[dict[int, int], int]]) -> None:
        by: dict[int, list[tuple[int, int, int, int]]] = {}
        used: Counter[int] = Counter()
        first = 0
        for pattern, n in patterns:
            offset = 0
            for w in sorted(pattern, reverse=True):
                by.setdefault(w, []).append((used[w], first, pattern[w], offset))
                used[w] += n * pattern[w]
                offset += w * pattern[w]
            first += n
        self.sequences = first
        self.by = {w: np.array(rows, dtype=np.int64).T for w, rows in by.items()}

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for at in np.split(order, cuts):
            if not len(at):
                continue
            w = int(length[at[0]])
            start, first, copies, off = self.by[w]
            r = rank[at]
            i = np.searchsorted(start, r, "right") - 1
            inside = r - start[i]
            sequence[at] = first[i] + inside // copies[i]
            offset[at] = off[i] + inside % copies[i] * w
        return sequence, offset


def tokenized_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids, part, nth)``: whole texts as ids, cut only where longer than ``capacity``.

    ``nth`` counts the pieces of the same length in the same ``part`` (task) before this one. Null text is empty and
    still has its end id. The table is written once, so part and nth are those of the attempt that was committed.
    """
    end = end_id.to_bytes(4, "little")

    def make():  # noqa: ANN202
        ids_of_all = ids_of(tokenizer).all
        part = TaskContext.get().partitionId()
        seen: Counter[int] = Counter()

        def cut(texts: list[str | None]):  # noqa: ANN202
            at, rows = [], []
            for i, ids in enumerate(ids_of_all(texts)):
                ids += end
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[start : start + 4 * capacity]
                    n = len(own) // 4
                    at.append(i)
                    rows.append((piece, start // 4, n, own, part, seen[n]))
                    seen[n] += 1
            return at, [list(c) for c in zip(*rows, strict=True)]

        return cut

    return materialize(over_texts(docs, make, "piece int, start long, length long, ids binary, part int, nth long"), "pieces")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``length``, ``part`` and ``nth``.

    What is collected, and sent to the tasks, is the histogram of lengths and the plan made from it: at most
    ``capacity`` lengths and a few patterns for each.
    """
    by = pieces.groupBy("part", "length").agg(F.count("*").alias("own"))
    by = materialize(by, "lengths")
    counts = {r["length"]: r["n"] for r in by.groupBy("length").agg(F.sum("own").alias("n")).collect()}
    places = Places(pack_lengths(counts, capacity))
    before = F.sum("own").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = by.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    # a table of tasks and lengths, which grows with the tasks: not to be sent to every one of them
    ranked = pieces.join(base.hint("merge"), ["part", "length"]).withColumn("rank", F.col("nth") + F.col("before")).drop("part", "nth", "before")
    out = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            placed = places.of(b.column("length").to_numpy(), b.column("rank").to_numpy())
            left = [c for c, n in zip(b.columns, b.schema.names, strict=True) if n != "rank"]
            yield pa.RecordBatch.from_arrays([*left, *map(pa.array, placed)], names=out.names)
        give_back()

    return ranked.mapInArrow(find, out)


def report(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: ``pieces``, ``tokens``, ``sequences`` of a placement, and ``lower_bound``, under which no packing of these pieces goes."""
    by = placed.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    counts = {r["length"]: r["n"] for r in by}
    sequences = placed.agg((F.coalesce(F.max("sequence_id"), F.lit(-1)) + 1).alias("sequences"))
    own = [F.lit(v).cast("long").alias(k) for k, v in (("pieces", sum(counts.values())), ("tokens", sum(w * n for w, n in counts.items())))]
    return sequences.select(*own, "sequences", F.lit(lower_bound(counts, capacity)).cast("long").alias("lower_bound"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """``(pieces with their ids, placement with each piece's crc32)`` of all ``docs(doc_id, text)``.

    The two tables join on doc_id and piece; to write the sequences themselves, group that join by sequence_id and
    order it by offset.
    """
    pieces = tokenized_pieces(docs, tokenizer, end_id, capacity)
    digest = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "part", "nth")
    return pieces, place(digest, capacity)


def op8_packing(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    import public_tokenizers

    from .shared import table

    _, placed = pack_documents(table(spark, sf_dir, "documents") if docs is None else docs, str(public_tokenizers.path("word_bpe_49k.json")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
