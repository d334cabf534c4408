"""N-dimensional arrays in long form, ``(i0, ..., value)``: selections, chunks, assembly, packed values, catalogues."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hyperslab(start: list[int], stride: list[int], count: list[int], block: list[int], dims: list[str]) -> Column:
    """Whether an element is in a regular selection. The bounds of each dimension stand apart from the stride, so a scan can be pruned by them."""
    out = F.lit(True)
    for d, s, t, c, b in zip(dims, start, stride, count, block, strict=True):
        off = F.col(d) - s
        out = out & F.col(d).between(s, s + (c - 1) * t + b - 1) & (off % t < b)
    return out


def points(array: DataFrame, wanted: DataFrame, dims: list[str]) -> DataFrame:
    """Values at ``wanted(ordinal, dims)``, in its order, repeated where it repeats; null outside of the array."""
    return wanted.join(array, dims, "left")


def chunk_of(dims: list[str], shape: list[int]) -> list[Column]:
    return [F.floor(F.col(d) / n).cast("long").alias(f"c{k}") for k, (d, n) in enumerate(zip(dims, shape, strict=True))]


def chunks_hit(array: DataFrame, dims: list[str], shape: list[int], lo: list[int], hi: list[int]) -> DataFrame:
    """Chunks that the bounding box of a selection touches."""
    ids = chunk_of(dims, shape)
    box = reduce(lambda a, b: a & b, [F.col(f"c{k}").between(lo[k] // shape[k], hi[k] // shape[k]) for k in range(len(dims))])
    return array.select(*ids).where(box).groupBy(*[f"c{k}" for k in range(len(dims))]).agg(F.count("*").alias("n"))


def overwrite(array: DataFrame, update: DataFrame, dims: list[str]) -> DataFrame:
    """``array`` with the values of ``update`` where that has one."""
    u = update.select(*dims, F.col("value").alias("_new"))
    return array.join(u, dims, "left").withColumn("value", F.coalesce("_new", "value")).drop("_new")


def virtual(grid: DataFrame, sources: list[tuple[DataFrame | None, list[int]]], dims: list[str], fill: float = 0.0) -> DataFrame:
    """Assemble ``sources`` (array, offsets) over ``grid(dims)``; a missing source is passed over, what none covers is ``fill``, later ones win."""
    moved = []
    for k, (s, at) in enumerate(sources):
        if s is not None:
            moved.append(s.select(*[(F.col(d) + o).alias(d) for d, o in zip(dims, at, strict=True)], "value", F.lit(k).alias("_k")))
    if not moved:
        return grid.withColumn("value", F.lit(fill))
    all_ = reduce(DataFrame.unionByName, moved)
    last = all_.groupBy(*dims).agg(F.max_by("value", "_k").alias("value"))
    return grid.join(last, dims, "left").withColumn("value", F.coalesce("value", F.lit(fill)))


def stripe(offset: Column, stripe_size: int, n_files: int) -> tuple[Column, Column]:
    """The file and the place in it of a byte of a striped array."""
    nth = F.floor(offset / stripe_size).cast("long")
    return nth % n_files, F.floor(nth / n_files).cast("long") * stripe_size + offset % stripe_size


def cf_unpack(value: Column, scale: Column, offset: Column, fill: Column, missing: Column) -> Column:
    """Packed to physical: fill and missing values are NaN, but only where a scale or an offset is given."""
    same = lambda x: F.coalesce(F.abs(value - x) < 2.220446049250313e-16, F.lit(False))
    packed = scale.isNotNull() | offset.isNotNull()
    out = value * F.coalesce(scale, F.lit(1.0)) + F.coalesce(offset, F.lit(0.0))
    return F.when(~packed, value).when(same(fill) | same(missing), F.lit(float("nan"))).otherwise(out)


def valid_range(attrs: Column) -> Column:
    """``valid_range`` if given, else ``valid_min`` and ``valid_max`` together, else null."""
    both = F.split(attrs["valid_range"], ",")
    pair = F.struct(F.element_at(both, 1).cast("double").alias("lo"), F.element_at(both, 2).cast("double").alias("hi"))
    ends = F.struct(attrs["valid_min"].cast("double").alias("lo"), attrs["valid_max"].cast("double").alias("hi"))
    return F.when(attrs["valid_range"].isNotNull(), pair).when(attrs["valid_min"].isNotNull() & attrs["valid_max"].isNotNull(), ends)


def dimensions(catalog: DataFrame) -> DataFrame:
    """Dimension scales in the order of their ids; where none is marked, every one-dimensional dataset."""
    scales = catalog.where(F.col("attrs")["CLASS"] == "DIMENSION_SCALE").select("path", F.element_at("shape", 1).alias("size"), F.col("attrs")["_Netcdf4Dimid"].cast("int").alias("dimid"))
    flat = catalog.where(F.size("shape") == 1).select("path", F.element_at("shape", 1).alias("size"), F.lit(None).cast("int").alias("dimid"))
    any_ = scales.agg((F.count("*") > 0).alias("_marked"))
    return scales.unionByName(flat.crossJoin(F.broadcast(any_)).where("not _marked").drop("_marked"))


def axis_names(shape: list[int], dims: list[tuple[str, int]]) -> list[str]:
    """For each axis the first unused dimension of its size, else ``dim_n``."""
    used: set[str] = set()
    out = []
    for k, n in enumerate(shape):
        name = next((d for d, size in dims if size == n and d not in used), f"dim_{k}")
        used.add(name)
        out.append(name)
    return out


def is_coordinate(path: Column, shape: Column, dim_names: Column) -> Column:
    """One-dimensional and named as its dimension."""
    return (F.size(shape) == 1) & (F.element_at(dim_names, 1) == F.element_at(F.split(path, "/"), -1))


def enum_name(code: Column, names: dict[int, str]) -> Column:
    table = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, code), F.concat(F.lit("UNKNOWN(0x"), F.lower(F.hex(code)), F.lit(")")))


#: (kind, bits): i signed, u unsigned, f floating.
def conversion_cost(source: Column, target: Column) -> Column:
    """None, Widening, Narrowing or Lossy, from names such as i32, u8, f64."""
    ks, kt = F.substring(source, 1, 1), F.substring(target, 1, 1)
    bs, bt = F.substring(source, 2, 9).cast("int"), F.substring(target, 2, 9).cast("int")
    mantissa = F.when(bt == 64, 53).when(bt == 32, 24).otherwise(11)
    return (
        F.when(source == target, "None")
        .when((ks == kt) & (bt > bs), "Widening")
        .when(ks == kt, "Narrowing")
        .when((ks == "u") & (kt == "i") & (bt > bs), "Widening")
        .when((kt == "f") & (bs <= mantissa), "Widening")
        .otherwise("Lossy")
    )



def dict_encode(rows: DataFrame, value: str, order: str) -> DataFrame:
    """``(value, code, n)``: codes by first appearance, over distinct values only."""
    first = rows.groupBy(F.col(value).alias("value")).agg(F.min(order).alias("first"), F.count("*").alias("n"))
    from .store import numbered

    return numbered(first, ["first", "value"], "code").select("value", F.col("code").cast("long").alias("code"), "n")


def dict_benefit(rows: DataFrame, value: str) -> DataFrame:
    """Whether to encode: at least four rows, at most three quarters of them distinct, and fewer bytes than before."""
    a = rows.agg(F.count("*").alias("n"), F.count_distinct(value).alias("n_unique"), F.sum(F.octet_length(value)).alias("plain_bytes"))
    d = rows.select(value).distinct().agg(F.sum(F.octet_length(value)).alias("dict_bytes"))
    j = a.crossJoin(F.broadcast(d)).withColumn("encoded_bytes", F.col("dict_bytes") + 4 * F.col("n"))
    ratio = F.col("plain_bytes") / F.col("encoded_bytes")
    return j.select("n", "n_unique", ratio.alias("ratio"), ((F.col("n") >= 4) & (F.col("n_unique") / F.col("n") <= 0.75) & (ratio > 1)).alias("beneficial"))


def sweeps(accesses: DataFrame, dims: list[str], by: str, order: str) -> DataFrame:
    """For each reader the axis that moves most between accesses, and the step expected next along it."""
    w = Window.partitionBy(by).orderBy(order)
    d = accesses.select(by, *[(F.col(x) - F.lag(x).over(w)).alias(f"d_{x}") for x in dims])
    moves = d.groupBy(by).agg(*[F.count_if(F.col(f"d_{x}") != 0).alias(f"n_{x}") for x in dims], *[F.sum(f"d_{x}").alias(f"s_{x}") for x in dims])
    best = F.greatest(*[F.struct(F.col(f"n_{x}").alias("n"), F.lit(-k).alias("k")) for k, x in enumerate(dims)])
    out = moves.withColumn("_b", best).withColumn("axis", -F.col("_b.k"))
    step = F.when(F.col("_b.n") == 0, 0)
    for k, x in enumerate(dims):
        step = step.when(F.col("axis") == k, F.expr(f"s_{x} div n_{x}"))
    return out.select(by, F.when(F.col("_b.n") > 0, F.col("axis")).alias("axis"), F.col("_b.n").alias("moves"), step.cast("long").alias("step"))


def sequential(accesses: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """How many accesses begin where the one before ended."""
    w = Window.partitionBy(by).orderBy(order)
    s = accesses.withColumn("seq", (F.lag("offset").over(w) + size) == F.col("offset"))
    return s.groupBy(by).agg(F.count("*").alias("n"), F.count_if("seq").alias("n_sequential"))


def seeded_lane(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The lane of each index by a seeded multiply-and-shift hash of 64 bits."""

    def mixed(x: np.ndarray) -> np.ndarray:
        k = np.uint64(0x517CC1B727220A95)
        x = x * k
        x = (x ^ (x >> np.uint64(33))) * k
        return x ^ (x >> np.uint64(29))

    return (mixed(np.uint64(seed) ^ mixed(index.astype(np.uint64))) % np.uint64(max(n, 1))).astype(np.int32)


def hash_lanes(rows: DataFrame, index: str, n: int, seed: int) -> DataFrame:
    """``lane`` for each row by its index: every task finds the same ones without asking others."""
    out = T.StructType([*rows.schema.fields, T.StructField("lane", T.IntegerType())])
    at = rows.columns.index(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seeded_lane(b.column(at).to_numpy(), n, seed))], names=out.names)

    return rows.mapInArrow(run, out)


def balanced_lanes(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """Lanes whose sizes differ by one at most."""
    from .store import numbered

    return numbered(rows, order, "_k").withColumn("lane", F.col("_k") % n).drop("_k")
