"""Byte-level filters of array chunks, half precision and keyed hashes, over numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashes import fletcher32_of


def shuffle(data: bytes, size: int) -> bytes:
    """All first bytes of the elements, then all second ones, and so on; a rest shorter than an element stays at the end."""
    n = len(data) // size * size
    return np.frombuffer(data[:n], np.uint8).reshape(-1, size).T.tobytes() + data[n:]


def unshuffle(data: bytes, size: int) -> bytes:
    n = len(data) // size * size
    return np.frombuffer(data[:n], np.uint8).reshape(size, -1).T.tobytes() + data[n:]


def _pack(codes: np.ndarray, bits: int) -> bytes:
    """Whole numbers of ``bits`` bits, the highest first, one after the other."""
    if not bits:
        return b""
    places = np.arange(bits - 1, -1, -1, dtype=np.uint64)
    return np.packbits((codes.astype(np.uint64)[:, None] >> places & 1).astype(np.uint8).ravel()).tobytes()


def _unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros(n, np.uint64)
    if len(data) * 8 < n * bits:
        raise ValueError("packed values end early")
    own = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits).astype(np.uint64)
    return (own << np.arange(bits - 1, -1, -1, dtype=np.uint64)).sum(1, dtype=np.uint64)


def offset_pack(values: np.ndarray) -> bytes:
    """Whole numbers as their least one and what they are above it, in as few bits as that takes."""
    low = int(values.min()) if len(values) else 0
    codes = (values.astype(np.int64) - low).astype(np.uint64)
    bits = int(codes.max()).bit_length() if len(codes) else 0
    return struct.pack("<IBq8x", bits, 8, low) + _pack(codes, bits)


def offset_unpack(data: bytes, n: int) -> np.ndarray:
    bits, width = struct.unpack_from("<IB", data)
    if bits > 64 or width > 8:
        raise ValueError("not a packed chunk")
    low = int.from_bytes(data[5 : 5 + width], "little", signed=True)
    return low + _unpack(data[5 + width + 8 :], n, bits).astype(np.int64)


def decimal_pack(values: np.ndarray, digits: int) -> bytes:
    """Numbers to ``digits`` decimal places, as above; the least one is kept as a double."""
    low = float(values.min()) if len(values) else 0.0
    codes = np.rint((values - low) * 10.0**digits).astype(np.uint64)
    bits = int(codes.max()).bit_length() if len(codes) else 0
    return struct.pack("<IBd8x", bits, 8, low) + _pack(codes, bits)


def decimal_unpack(data: bytes, n: int, digits: int) -> np.ndarray:
    bits, width, low = struct.unpack_from("<IBd", data)
    return low + _unpack(data[5 + width + 8 :], n, bits).astype(np.float64) / 10.0**digits


def n_bit_pack(values: np.ndarray, bits: int, offset: int = 0) -> bytes:
    """The ``bits`` bits above ``offset`` of each unsigned number."""
    return _pack(values.astype(np.uint64) >> np.uint64(offset) & np.uint64((1 << bits) - 1), bits)


def n_bit_unpack(data: bytes, n: int, bits: int, offset: int = 0) -> np.ndarray:
    return _unpack(data, n, bits) << np.uint64(offset)


def sealed(data: bytes) -> bytes:
    """With a Fletcher-32 checksum behind."""
    return data + struct.pack("<I", fletcher32_of(data))


def opened(data: bytes) -> bytes:
    if len(data) < 4 or struct.unpack("<I", data[-4:])[0] != fletcher32_of(data[:-4]):
        raise ValueError("the checksum doesn't match")
    return data[:-4]


def encode_chunk(values: np.ndarray, digits: int) -> bytes:
    """A chunk of doubles through the filters in order: decimal packing, shuffle, deflate, checksum."""
    return sealed(zlib.compress(shuffle(decimal_pack(values, digits), 8), 6))


def decode_chunk(data: bytes, n: int, digits: int) -> np.ndarray:
    return decimal_unpack(unshuffle(zlib.decompress(opened(data)), 8), n, digits)


def half_bits(values: np.ndarray) -> np.ndarray:
    """Bits of the nearest half-precision numbers, ties to even."""
    with np.errstate(over="ignore"):
        return values.astype(np.float16).view(np.uint16)


def from_half_bits(bits: np.ndarray) -> np.ndarray:
    return bits.astype(np.uint16).view(np.float16).astype(np.float32)


def half(x: Column) -> Column:
    """The nearest half-precision number, as a double, in built-in functions: eleven bits, subnormal under 2^-14, infinite from 65,520 on."""
    v = x.cast("double")
    bits = F.floor(F.log2(F.abs(v))).cast("int")
    # a logarithm may be rounded over a power of two
    bits = F.when(F.pow(F.lit(2.0), bits) > F.abs(v), bits - 1).when(F.pow(F.lit(2.0), bits + 1) <= F.abs(v), bits + 1).otherwise(bits)
    step = F.pow(F.lit(2.0), F.greatest(bits, F.lit(-14)) - 10)
    inf = F.lit(float("inf"))
    return F.when((v == 0) | F.isnan(v) | (F.abs(v) == inf), v).when(F.abs(v) >= 65520, F.signum(v) * inf).otherwise(F.rint(v / step) * step)


def hmac_sha256(data: Column, key: bytes) -> Column:
    """HMAC with SHA-256, as hex, of two nested hashes in built-in functions."""
    import hashlib

    own = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in own).hex()))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), data), 256))), 256)
