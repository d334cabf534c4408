"""Token ids of whole texts with a public tokenizer's file, fast enough for a corpus.

The tokenizers library spends most of its time outside the merges. Both files here cut a text into pretokens that are
merged on their own, so a worker cuts with the same expression and numbers the chunks between blanks. Chunks that it hasn't
met are merged many at a time, with numpy and the file's own merges; the ids of a text are then gathered by its numbers.
Texts whose cutting could differ by a rare character, or that hold the string of an added token, go to the library whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

#: Bytes of chunks and their ids that a worker remembers, as far as a block's own don't exceed them. This and the next three change speed only.
REMEMBERED = 64 << 20
#: Characters of texts whose chunks are looked up at a time.
BLOCK = 2 << 20
#: Bytes of a pretoken beyond which the library merges it.
LONG = 48
#: Pretokens that are merged at a time; times LONG + 1 it must stay below 2^PLACE.
WORDS = 4096

_BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_WORD_END = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: What the two libraries class or lower-case differently.
_ODD_BYTE = re.compile("[\x1c-\x1f\x85᠎​-‏﻿]|[^\x00-ӿḀ-⃏]")
_ODD_WORD = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9fİΣ᠎​-‏﻿]|[^\x00-ӿḀ-⃏]")

#: What ends most chunks that are more than a word, and is a pretoken there.
_STOPS = frozenset(".,")
#: Bits of a place in a block of pretokens, and the rank of what doesn't merge.
PLACE, NEVER = 18, 1 << 40


def _byte_map() -> dict[int, str]:
    """The published byte-to-character table of byte-level BPE."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(plain))}


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all runs, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Ranks:
    """From two ids to the rank of their merge: a table with open addresses, at most a quarter full."""

    def __init__(self, ranks: dict[tuple[int, int], int]) -> None:
        self.bits = (4 * len(ranks)).bit_length()
        self.keys = np.full(1 << self.bits, -1)
        self.ranks = np.full(1 << self.bits, NEVER)
        both = np.array(list(ranks), np.int64).reshape(-1, 2)
        keys, values = both[:, 0] << 32 | both[:, 1], np.fromiter(ranks.values(), np.int64, len(ranks))
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] == -1
            self.keys[slots[free]] = keys[free]  # of several for one slot the last stays
            there = self.keys[slots] == keys
            self.ranks[slots[there]] = values[there]
            keys, values, slots = keys[~there], values[~there], self._next(slots[~there])

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def _next(self, slots: np.ndarray) -> np.ndarray:
        return (slots + 1) & (len(self.keys) - 1)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NEVER for what doesn't merge; an id of -1 doesn't merge with any."""
        keys = left << 32 | right
        slots = self._slots(keys)
        found = self.keys[slots]
        other = found != keys
        out = np.where(other, NEVER, self.ranks[slots])
        at = np.flatnonzero(other & (found != -1))
        slots, keys = slots[at], keys[at]
        while len(at):
            slots = self._next(slots)
            found = self.keys[slots]
            here = found == keys
            out[at[here]] = self.ranks[slots[here]]
            more = ~here & (found != -1)
            at, slots, keys = at[more], slots[more], keys[more]
        return out


class _Merges:
    """The merges of a byte-pair model, of many pretokens at a time: in each the lowest rank first, of equal ones the leftmost."""

    def __init__(self, model: dict) -> None:
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("not a plain byte-pair model")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = _Ranks({(vocab[a], vocab[b]): k for k, (a, b) in enumerate(pairs)})
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        #: Ids of bytes, and of bytes that end a pretoken.
        self.inner, self.last = (np.array([vocab[c + end] for _, c in sorted(_byte_map().items())], np.int64) for end in ("", suffix))

    def of(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, numbers of ids)`` of at most WORDS pretokens of 1 to LONG bytes in ``data``."""
        w, n = len(starts), int(lengths.max())
        places = np.arange(n)[:, None]
        ids = np.full((n + 1, w), -1)  # a row for each place, and one that never merges behind and before them
        ids[:n] = np.where(places < lengths, self.inner[data[np.minimum(starts + places, len(data) - 1)]], -1)
        ids[lengths - 1, np.arange(w)] = self.last[data[starts + lengths - 1]]
        ids = ids.reshape(-1)
        at = np.arange(len(ids))
        after, before = at + w, at - w
        before[:w] += len(ids)
        codes = np.full(len(ids), NEVER << PLACE)
        codes[:-w] = self.ranks.of(ids[:-w], ids[w:]) << PLACE | at[:-w]
        grid = codes[:-w].reshape(n, w)
        while True:
            best = grid.min(axis=0)
            best = best[best < NEVER << PLACE]
            if not len(best):
                break
            i, new = best & ((1 << PLACE) - 1), self.made[best >> PLACE]
            j, h = after[i], before[i]
            k = after[j]
            ids[i], ids[j], codes[j] = new, -1, NEVER << PLACE
            after[i], before[k] = k, i
            codes[h] = self.ranks.of(ids[h], new) << PLACE | h
            codes[i] = self.ranks.of(new, ids[k]) << PLACE | i
        words = ids[:-w].reshape(n, w).T
        left = words >= 0
        return words[left], left.sum(axis=1)


class _Numbers(dict):
    """Chunks by the order in which they came; ``new`` are those whose ids aren't known yet."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.new.append(chunk)
        return n


class Ids:
    """``all(texts)``: the ids of each text as little-endian unsigned 32-bit integers, without special ids; ``of(text)``: those of one.

    They are those of the library's ``encode(text, add_special_tokens=False)``: a string of an added token in a text is that token. A
    null text is an empty one.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.merge = self.whole.model.tokenize
        self.merges = _Merges(json.loads(self.whole.to_str())["model"])
        self.byte_level = self.whole.normalizer is None
        self.table = _byte_map()
        self.cut = (_BYTE_LEVEL if self.byte_level else _WORD_END).findall
        added = sorted({t.content for t in self.whole.get_added_tokens_decoder().values()} - {""})
        if any(t.normalized or t.single_word for t in self.whole.get_added_tokens_decoder().values()):
            raise ValueError(f"{path} has added tokens that are looked for in normalised text")
        self.added = added
        self.odd = (_ODD_BYTE if self.byte_level else _ODD_WORD).search
        self.lead = " " if self.byte_level else ""
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.ids, self.ends = array("I"), array("q", [0])  # of chunks by number
        self.size = 0

    def library(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _strange(self, text: str) -> bool:
        if self.odd(text) or any(t in text for t in self.added):
            return True
        # runs of blanks cross the borders of chunks
        return "  " in text if self.byte_level else not unicodedata.is_normalized("NFC", text)

    def _chunks(self, text: str) -> Iterator[list[str]]:
        """What stands between blanks, of about BLOCK characters at a time. A blank before a chunk says that none is before it in the text."""
        at = 0
        while at >= 0:
            end = text.find(" ", at + BLOCK)
            part = text[at : end if end >= 0 else None]
            chunks = part.split(" ") if self.byte_level else part.lower().split()
            if self.byte_level and not at:
                chunks[0] = " " + chunks[0]
            yield chunks
            at = end + 1 if end >= 0 else -1

    def _learn(self) -> None:
        """Remember the ids of the chunks that are new."""
        parts: list[str] = []
        counts = []
        lead = self.lead
        for chunk in self.numbers.new:
            if chunk.isalpha():
                parts.append(lead + chunk)
                counts.append(1)
            elif chunk[-1:] in _STOPS and (word := chunk[:-1]).isalpha():
                parts += (lead + word, chunk[-1])
                counts.append(2)
            else:
                own = self.cut(chunk[1:] if chunk[:1] == " " else lead + chunk)
                parts += own
                counts.append(len(own))
        _, offsets, data = pa.array(parts, pa.large_string()).buffers()
        offsets = np.frombuffer(offsets, np.int64)[: len(parts) + 1] if parts else np.zeros(1, np.int64)
        sizes = np.diff(offsets)
        order = np.argsort(sizes, kind="stable")
        short = int(np.searchsorted(sizes[order], LONG, "right"))
        ids, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, short, WORDS):
            at = order[lo : min(lo + WORDS, short)]
            for column, x in zip((ids, lengths), self.merges.of(np.frombuffer(data, np.uint8), offsets[at], sizes[at]), strict=True):
                column.append(x)
        for i in order[short:].tolist():
            ids.append(np.array([t.id for t in self.merge(parts[i].encode().decode("latin-1").translate(self.table))], np.int64))
            lengths.append(np.array([len(ids[-1])]))
        ids, lengths = np.concatenate(ids), np.concatenate(lengths)
        starts, own = np.zeros_like(sizes), np.zeros_like(sizes)
        starts[order], own[order] = np.cumsum(lengths) - lengths, lengths
        ends = np.concatenate([[0], np.cumsum(own)])[np.cumsum(counts, dtype=np.int64)]
        self.ends.frombytes((ends + self.ends[-1]).tobytes())
        self.ids.frombytes(ids[_ragged(starts, own)].astype(np.uint32).tobytes())
        self.size += 190 * len(counts) + int(offsets[-1]) + 4 * len(ids)  # about what they take, their places in the table included
        self.numbers.new = []

    def _gather(self, found: list[np.ndarray]) -> Iterator[bytes]:
        """The ids of each list of numbers."""
        if self.numbers.new:
            self._learn()
        at = np.concatenate(found)
        ends = np.asarray(self.ends)
        starts = ends[at]
        lengths = ends[at + 1] - starts
        ids = np.asarray(self.ids)[_ragged(starts, lengths)].astype("<u4").tobytes()
        to = 4 * np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([len(f) for f in found])]
        lo = 0
        for hi in to.tolist():
            yield ids[lo:hi]
            lo = hi

    def all(self, texts: list[str | None]) -> list[bytes]:
        got: list[list[bytes]] = [[] for _ in texts]
        whose: list[int] = []
        found: list[np.ndarray] = []
        size = 0

        def settle() -> None:
            for k, ids in zip(whose, self._gather(found) if found else (), strict=True):
                got[k].append(ids)
            whose.clear()
            found.clear()
            if self.size > REMEMBERED:
                self._forget()

        for k, text in enumerate(texts):
            if not text:
                continue
            if self._strange(text):
                got[k].append(self.library(text))
                continue
            for chunks in self._chunks(text):
                whose.append(k)
                found.append(np.fromiter(map(self.numbers.__getitem__, chunks), np.int64, len(chunks)))
                size += min(len(text), BLOCK)
                if size >= BLOCK:
                    settle()
                    size = 0
        settle()
        return [b"".join(parts) for parts in got]

    def of(self, text: str | None) -> bytes:
        return self.all([text])[0]


@lru_cache(maxsize=1)
def ids_of(path: str) -> Ids:
    """One for each worker process and file."""
    return Ids(path)
