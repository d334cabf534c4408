"""Checksums and content hashes. 64-bit unsigned values are longs with the same bits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fnv1a64(text: Column) -> Column:
    """FNV-1a over UTF-8 bytes as 16 hex digits; arithmetic on 32-bit halves, since wide products overflow a long."""
    mask = F.lit(0xFFFFFFFF)
    hexed = F.hex(F.encode(text, "UTF-8"))
    n = (F.length(hexed) / 2).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    octets = F.transform(at, lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))

    def step(acc: Column, b: Column) -> Column:
        x = acc["lo"].bitwiseXOR(b)
        low = x * 435
        high = acc["hi"] * 435 + F.shiftrightunsigned(low, 32) + F.shiftleft(x, 8).bitwiseAND(mask)
        return F.struct(high.bitwiseAND(mask).alias("hi"), low.bitwiseAND(mask).alias("lo"))

    done = F.aggregate(octets, start, step)
    return F.when(text.isNotNull(), F.lower(F.concat(F.lpad(F.hex(done["hi"]), 8, "0"), F.lpad(F.hex(done["lo"]), 8, "0"))))


def fnv1a64_fast(text: Column) -> Column:
    """The same, for long texts."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for t in s:
                if t is None:
                    out.append(None)
                    continue
                h = 0xCBF29CE484222325
                for b in t.encode():
                    h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
                out.append(f"{h:016x}")
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)(text)


def fletcher32_of(data: bytes) -> int:
    """Fletcher-32 over big-endian 16-bit words; a last odd byte is the high half of a word."""
    if len(data) % 2:
        data += b"\x00"
    a = b = 0
    for i in range(0, len(data), 2):
        a = (a + (data[i] << 8 | data[i + 1])) % 65535
        b = (b + a) % 65535
    return b << 16 | a


def lookup3_of(data: bytes, seed: int = 0) -> int:
    """Jenkins' lookup3, the little-endian 32-bit variant."""
    m = 0xFFFFFFFF
    rot = lambda x, k: ((x << k) | (x >> (32 - k))) & m
    a = b = c = (0xDEADBEEF + len(data) + seed) & m
    i, n = 0, len(data)
    word = lambda at: int.from_bytes(data[at : at + 4], "little")
    while n - i > 12:
        a, b, c = (a + word(i)) & m, (b + word(i + 4)) & m, (c + word(i + 8)) & m
        for x, y, z, k in ((0, 2, 1, 4), (1, 0, 2, 6), (2, 1, 0, 8), (0, 2, 1, 16), (1, 0, 2, 19), (2, 1, 0, 4)):
            v = [a, b, c]
            v[x] = ((v[x] - v[y]) & m) ^ rot(v[y], k)
            v[y] = (v[y] + v[z]) & m
            a, b, c = v
        i += 12
    tail = data[i:]
    if not tail:
        return c
    tail = tail.ljust(12, b"\x00")
    a, b, c = ((v + int.from_bytes(tail[k : k + 4], "little")) & m for v, k in ((a, 0), (b, 4), (c, 8)))
    for x, y, k in (("c", "b", 14), ("a", "c", 11), ("b", "a", 25), ("c", "b", 16), ("a", "c", 4), ("b", "a", 14), ("c", "b", 24)):
        v = {"a": a, "b": b, "c": c}
        v[x] = ((v[x] ^ v[y]) - rot(v[y], k)) & m
        a, b, c = v["a"], v["b"], v["c"]
    return c


def _checksum(data: Column, of: Callable[[bytes], int]) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else of(bytes(x)))

    return F.pandas_udf(run, "long", F.PandasUDFType.SCALAR)(data)


def fletcher32(data: Column) -> Column:
    return _checksum(data, fletcher32_of)


def lookup3(data: Column) -> Column:
    return _checksum(data, lookup3_of)


def sha256_status(content: Column, recorded: Column) -> Column:
    """Ok, Mismatch, or NoHash where none was recorded."""
    return F.when(recorded.isNull(), "NoHash").when(F.sha2(content, 256) == F.lower(recorded), "Ok").otherwise("Mismatch")


def leaf_hash(text: Column) -> Column:
    """Merkle leaf: SHA-256 of a zero byte and the content, as hex."""
    return F.sha2(F.concat(F.unhex(F.lit("00")), F.encode(text, "UTF-8")), 256)


def node_hash(left: Column, right: Column) -> Column:
    return F.sha2(F.unhex(F.concat(F.lit("01"), left, right)), 256)


#: SHA-256 of 0x02 and "null": what fills a tree up to a power of two.
PAD_INPUT = b"\x02null"
