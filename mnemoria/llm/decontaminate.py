"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may differ from a passage by ``k = floor(rate * n)`` edits. Cut into k + 1 pieces, at least one
piece stands unchanged in any such passage. All pieces of all items are found in one walk over a document
(Aho-Corasick), and what surrounds a hit is verified with Myers' bit-parallel distance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import keep_rows, materialize, over_texts

ERROR_RATE = 0.05
#: Characters of test items that are matched in one walk; more are walked in blocks of this size.
BLOCK_CHARS = 8_000_000
#: Items with fewer words than this are matched exactly, between word borders: with errors they would stand nearly everywhere.
MIN_WORDS = 5
_BLANK = re.compile(r"\s+")


def normalise(text: str | None) -> str:
    """Lower case, runs of white space as one blank, none at the ends."""
    return _BLANK.sub(" ", text.lower()).strip() if text else ""


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length, each with its place."""
    n, parts = len(item), errors + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Myers:
    """Least edit distance of a pattern to any substring of a text, 64 or however many rows at once."""

    def __init__(self, pattern: str) -> None:
        self.m = len(pattern)
        self.peq: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.peq[c] = self.peq.get(c, 0) | 1 << i

    def best(self, text: str, most: int) -> tuple[int, int] | None:
        """``(distance, end)`` of the best match with at most ``most`` edits, the first of those equal; None if there is none."""
        m, get = self.m, self.peq.get
        full, top = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score = full, 0, m
        found: tuple[int, int] | None = None
        for j, c in enumerate(text):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = (ph << 1) & full
            mh = (mh << 1) & full
            pv = mh | (full & ~(xv | ph))
            mv = ph & xv
            if score <= most and (found is None or score < found[0]):
                found = (score, j + 1)
        return found


class Matcher:
    """Finds every test item of a block in a text."""

    def __init__(self, items: tuple[tuple[int, str], ...], rate: float, min_words: int = MIN_WORDS) -> None:
        self.items = items
        self.short = [t.count(" ") + 1 < min_words for _, t in items]
        self.errors = [0 if short else int(rate * len(t)) for short, (_, t) in zip(self.short, items, strict=True)]
        self.myers = [Myers(t) for _, t in items]
        by: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t) in enumerate(items):
            for at, p in pieces(t, self.errors[k]):
                by.setdefault(p, []).append((k, at))
        self.walk = ahocorasick.Automaton()
        for p, where in by.items():
            self.walk.add_word(p, (len(p), where))
        self.walk.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """``(item_id, distance, start, end)`` in the normalised text: for each item its best passage, start being approximate by k."""
        windows: dict[int, list[list[int]]] = {}
        for end, (length, where) in self.walk.iter(text):
            begin = end - length + 1
            for k, at in where:
                if self.short[k] and not _alone(text, begin, end + 1):
                    continue
                e, n = self.errors[k], len(self.items[k][1])
                lo, hi = max(0, begin - at - e), min(len(text), begin - at + n + e)
                own = windows.setdefault(k, [])
                # hits come by their ends, so a window overlaps the last one if any
                if own and lo <= own[-1][1] and hi >= own[-1][0] and hi - own[-1][0] <= 8 * (n + 2 * e):
                    own[-1][0], own[-1][1] = min(lo, own[-1][0]), max(hi, own[-1][1])
                elif not own or lo < own[-1][0] or hi > own[-1][1]:
                    own.append([lo, hi])
        out = []
        for k, spans in windows.items():
            item_id, t = self.items[k]
            best: tuple[int, int, int, int] | None = None
            for lo, hi in spans:
                part = text[lo:hi]
                at = part.find(t)
                got = (0, at + len(t)) if at >= 0 else self.myers[k].best(part, self.errors[k])
                if got and (best is None or got[0] < best[1]):
                    best = (item_id, got[0], max(lo, lo + got[1] - len(t)), lo + got[1])
                    if not got[0]:
                        break
            if best:
                out.append(best)
        return sorted(out)


def _alone(text: str, start: int, end: int) -> bool:
    """Whether no word goes on over either border."""
    inside = text[start].isalnum(), text[end - 1].isalnum()
    return not (inside[0] and start and text[start - 1].isalnum()) and not (inside[1] and end < len(text) and text[end].isalnum())


@lru_cache(maxsize=1)
def _matcher(items: tuple[tuple[int, str], ...], rate: float, min_words: int) -> Matcher:
    return Matcher(items, rate, min_words)


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[tuple[int, str], ...]]:
    """Normalised test items, by id, in blocks of at most ``block_chars`` characters or one longer item; one block is held at a time."""
    block: list[tuple[int, str]] = []
    size = 0
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    for r in items.distinct().orderBy("item_id", "text").toLocalIterator():
        t = normalise(r["text"])
        if not t:
            continue
        if block and size + len(t) > block_chars:
            yield tuple(block)
            block, size = [], 0
        block.append((r["item_id"], t))
        size += len(t)
    if block:
        yield tuple(block)


def _sent(docs: DataFrame, benchmark: DataFrame, block_chars: int) -> Iterator[tuple[Broadcast, bool]]:
    """Each block as a broadcast, and whether it is the last; those before it are taken back as soon as they are used."""
    sc = docs.sparkSession.sparkContext
    held = None
    for block in blocks(benchmark, block_chars):
        if held is not None:
            yield held, False
            held.unpersist()
        held = sc.broadcast(block)
    if held is not None:
        yield held, True


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, item_id, distance, start, end)``: test items that stand in a document with at most ``rate`` edits a character.

    Texts are compared as ``normalise`` gives them and start and end count its characters. Null or empty documents hold
    nothing; null and blank items are no test items; items without an id are passed over, equal rows are one item. Items of fewer than
    ``min_words`` words must stand exactly and not go on as a word on either side. A document without an id is reported without one.
    Repeated rows are reported each. Test items are a query set: a block of at most ``block_chars`` characters, cut by item id, is
    sent to the tasks at a time, and every document is held against every block; of several, each block's finds are a table.
    """

    def search(sent: Broadcast) -> DataFrame:
        def make():  # noqa: ANN202
            find = _matcher(sent.value, rate, min_words).find

            def of(texts: list[str | None]):  # noqa: ANN202
                rows = [(i, *m) for i, t in enumerate(texts) if t for m in find(normalise(t))]
                return ([r[0] for r in rows], [[r[k] for r in rows] for k in (1, 2, 3, 4)])

            return of

        return over_texts(docs.where("text is not null"), make, "item_id long, distance int, start long, end long")

    out: DataFrame | None = None
    for sent, last in _sent(docs, benchmark, block_chars):
        found = search(sent) if last else materialize(search(sent), "leaks")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance int, start long, end long")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows that hold a test item, by the rules of ``leaks``. Rows are judged, so an id need not be there or be unique."""

    def clean(docs: DataFrame, sent: Broadcast) -> DataFrame:
        def make():  # noqa: ANN202
            find = _matcher(sent.value, rate, min_words).find
            return lambda texts: [not t or not find(normalise(t)) for t in texts]

        return keep_rows(docs, make)

    for sent, last in _sent(docs, benchmark, block_chars):
        docs = clean(docs, sent) if last else materialize(clean(docs, sent), "clean")
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import table

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
