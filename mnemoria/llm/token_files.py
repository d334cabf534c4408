"""Token-id files: independent zstandard frames with a trailing seek table and per-frame checksums.

A file is, in order:

* one zstandard frame for each document, in ascending doc_id order: its ids as little-endian unsigned
  32-bit integers, with the content size and zstandard's own content checksum;
* a skippable frame (magic 0x184D2A50) with the documents' ids as little-endian signed 64-bit integers, zstandard-packed;
* the seek table of the published seekable format: a skippable frame (magic 0x184D2A5E) with, for each frame,
  compressed size, decompressed size and the low 32 bits of the content's XXH64, then a footer of the number
  of frames, a descriptor byte (0x80: checksums present) and the magic 0x8F92EAB1.

Any zstandard decoder reads the whole file as one stream of ids; a reader that wants one document reads the
tail, one slice, and decompresses that frame alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Attempt, file_system
from .shared import fresh_path, give_back, materialize, slices
from .tokens import ids_of

SEEK_MAGIC, DOC_MAGIC, FOOTER_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])


def write_file(out: object, docs: Iterable[tuple[int, bytes]], level: int = 1) -> tuple[int, int]:
    """Write ``(doc_id, ids)`` to the binary stream ``out``; returns documents and ids written."""
    pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress
    ids: list[int] = []
    entries: list[tuple[int, int, int]] = []
    for doc_id, plain in docs:
        packed = pack(plain)
        out.write(packed)
        ids.append(doc_id)
        entries.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
    table = np.array(entries, dtype=_ENTRY)
    names = pack(np.array(ids, dtype="<i8").tobytes())
    out.write(struct.pack("<II", DOC_MAGIC, len(names)) + names)
    body = table.tobytes() + struct.pack("<IBI", len(entries), 0x80, FOOTER_MAGIC)
    out.write(struct.pack("<II", SEEK_MAGIC, len(body)) + body)
    return len(ids), int(table["plain"].astype(np.int64).sum()) // 4


class TokenFile:
    """Random access to one file. ``ids(k)`` reads and decompresses the k-th frame only and checks it."""

    def __init__(self, path: str) -> None:
        system, at = file_system(path)
        self.file = system.open_input_file(at)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._slice(size - 9, 9))
        if magic != FOOTER_MAGIC or flags != 0x80:
            raise ValueError(f"{path} has no seek table with checksums")
        length = n * _ENTRY.itemsize + 9
        start = size - length - 8
        magic, said = struct.unpack("<II", self._slice(start, 8))
        if magic != SEEK_MAGIC or said != length:
            raise ValueError(f"{path} has a broken seek table")
        self.table = np.frombuffer(self._slice(start + 8, length - 9), dtype=_ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.table["packed"], dtype=np.int64)])
        at_names = int(self.starts[-1])
        magic, said = struct.unpack("<II", self._slice(at_names, 8))
        if magic != DOC_MAGIC or at_names + 8 + said != start:
            raise ValueError(f"{path} has no document ids")
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.doc_ids = np.frombuffer(self.unpack(self._slice(at_names + 8, said)), dtype="<i8")

    def _slice(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        got = self.file.read(n)
        if len(got) != n:
            raise ValueError("the file ends early")
        return got

    def __len__(self) -> int:
        return len(self.table)

    def _checked(self, k: int, packed: bytes) -> bytes:
        plain = self.unpack(packed)
        if len(plain) != self.table["plain"][k] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.table["check"][k]:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return plain

    def ids(self, k: int) -> bytes:
        return self._checked(k, self._slice(int(self.starts[k]), int(self.table["packed"][k])))

    def find(self, doc_id: int) -> list[bytes]:
        """The ids of every document so named (names may repeat)."""
        lo, hi = np.searchsorted(self.doc_ids, [doc_id, doc_id + 1])
        return [self.ids(k) for k in range(lo, hi)]

    def all(self, step: int = 4 << 20) -> Iterator[tuple[int, bytes]]:
        """Every document in order, reading slices of about ``step`` bytes."""
        k, n = 0, len(self)
        while k < n:
            end = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + step, "right")) - 1)
            block, base = self._slice(int(self.starts[k]), int(self.starts[end] - self.starts[k])), self.starts[k]
            for i in range(k, end):
                yield int(self.doc_ids[i]), self._checked(i, block[self.starts[i] - base : self.starts[i + 1] - base])
            k = end


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, partitions: int | None = None) -> DataFrame:
    """Encode ``docs(doc_id, text)`` into files in ``folder``, one for each range of doc_id; returns the list of files.

    The list ``(file, part, n_docs, n_tokens, first_id)`` has a row for each file, as many as partitions. Null text is empty;
    rows without a doc_id have no place in the order and are left out. Repeated doc_ids stay, ordered by a hash of the text.
    ``tokenizer`` is a path that every executor has.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows repeated under one id are dealt by their texts' hashes, in which order they also stand
    ordered = ordered.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    end = end_id.to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of_all = ids_of(tokenizer).all
        first: list[int] = []

        def encoded() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                for b in slices(batch):
                    names = b.column("doc_id").to_pylist()
                    first.extend(names[: not first])
                    for doc_id, ids in zip(names, ids_of_all(b.column("text").to_pylist()), strict=True):
                        yield doc_id, ids + end

        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}.ids.zst"
        with Attempt(folder, name) as out:
            docs_n, tokens = write_file(out, encoded())
        give_back()
        columns = [[name], pa.array([part], pa.int32()), [docs_n], [tokens], pa.array(first or [None], pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, list) else c for c in columns], ["file", "part", "n_docs", "n_tokens", "first_id"])

    return materialize(ordered.mapInArrow(write, "file string, part int, n_docs long, n_tokens long, first_id long"), "token-files")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document in the files; ``start`` counts all ids before it.

    Only the list of files, a row for each, passes through the driver.
    """
    spark = files.sparkSession
    rows = sorted((r for r in files.collect() if r["n_docs"]), key=lambda r: r["part"])
    base, at = [], 0
    for r in rows:
        base.append((r["file"], at))
        at += r["n_tokens"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, start in zip(b["file"], b["base"].tolist(), strict=True):
                held: list[tuple] = []
                size = 0
                for doc_id, ids in TokenFile(f"{folder}/{name}").all():
                    held.append((doc_id, start, len(ids) // 4, ids))
                    start += len(ids) // 4
                    size += len(ids)
                    if size > 8 << 20:
                        yield pd.DataFrame(held, columns=["doc_id", "start", "n_tokens", "ids"])
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held, columns=["doc_id", "start", "n_tokens", "ids"])

    listed = spark.createDataFrame(base or [("", 0)], "file string, base long").where("file <> ''").repartition(max(1, len(base)))
    return listed.mapInPandas(read, "doc_id long, start long, n_tokens long, ids binary")


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .shared import table

    folder = fresh_path(spark, "ids")
    files = write_token_files(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), folder)
    return read_token_files(files, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
