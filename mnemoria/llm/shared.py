"""Where intermediate tables live, and helpers that every operator of this subpackage shares."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of texts that are Python strings at a time, one text at least.
SLICE = 4 << 20
#: Bytes of an Arrow batch while a table is written.
BATCH = 8 << 20
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that setting is absent and Spark runs in one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="mnemoria-")
    return _OWN[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/mnemoria/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, jobs hand rows to Python in batches of about BATCH bytes: both sides hold a batch or two for each running task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The copy cuts lineage and outlives lost executors, unlike cached blocks or local checkpoints.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return what a finished task has freed to the system: Python workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """``batch`` in parts whose ``column`` holds about SLICE bytes, or one longer text."""
    size = batch.column(column).nbytes
    if size <= SLICE:
        yield batch
        return
    lengths = [x or 0 for x in pa.compute.binary_length(batch.column(column)).to_pylist()]
    at, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > SLICE:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    yield batch.slice(at)


#: Of texts: columns for each of them, or the texts' indices and columns for each of those.
PerText = Callable[[list[str | None]], tuple[list[int] | None, list]]


def over_texts(docs: DataFrame, make: Callable[[], PerText], schema: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(*keys, *schema)``: what ``make()`` says of the texts of ``docs``, for each row or several times for one.

    Keys stay Arrow arrays: pandas would make doubles of long ids beside a null, and of those no id above 2^53 comes back.
    """
    own = docs.select(*[F.col(k).cast("long").alias(k) if k == "doc_id" else F.col(k) for k in keys], F.col("text").cast("string").alias("text"))
    out = T.StructType([*own.drop("text").schema.fields, *T.StructType.fromDDL(schema).fields])
    arrow = _arrow(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            for b in slices(batch):
                at, columns = of(b.column(len(keys)).to_pylist())
                left = [b.column(i) if at is None else b.column(i).take(pa.array(at, pa.int64())) for i in range(len(keys))]
                columns = [pa.array(c, f.type) for c, f in zip([*left, *columns], arrow, strict=True)]
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        del of
        give_back()

    return own.mapInArrow(run, out)


def keep_rows(docs: DataFrame, make: Callable[[], Callable[[list[str | None]], list[bool]]]) -> DataFrame:
    """The rows of ``docs`` of whose texts ``make()`` says yes. Rows are judged, not ids, so that no id need be there or be unique."""

    name = "text_to_judge"
    while name in docs.columns:
        name += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            for b in slices(batch, name):
                kept = b.filter(pa.array(of(b.column(name).to_pylist()), pa.bool_()))
                if len(kept):
                    yield kept.select(kept.schema.names[:-1])
        del of
        give_back()

    return docs.withColumn(name, F.col("text").cast("string")).mapInArrow(run, docs.schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    plain = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}

    def of(t: T.DataType) -> pa.DataType:
        return pa.list_(of(t.elementType)) if isinstance(t, T.ArrayType) else plain[t.simpleString()]

    return pa.schema([(f.name, of(f.dataType)) for f in schema.fields])


def stream_groups(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Groups of equal ``keys`` from batches that arrive sorted by them; one group is held at a time.

    Spark's grouped-map call costs about a millisecond for each group; this costs a slice.
    """
    held: list[pd.DataFrame] = []
    held_key: tuple | None = None
    for batch in batches:
        if not len(batch):
            continue
        change = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy()
        change[0] = True
        at = [*change.nonzero()[0], len(batch)]
        for lo, hi in zip(at, at[1:], strict=False):
            part = batch.iloc[lo:hi]
            key = tuple(part[keys].iloc[0])
            if held and key != held_key:
                yield held_key, held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            held_key = key
            held.append(part)
    if held:
        yield held_key, held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def over_groups(df: DataFrame, keys: list[str], fn: Callable[[tuple, pd.DataFrame], pd.DataFrame | None], schema: str, extra_order: list[str] | None = None) -> DataFrame:
    """Apply ``fn`` to each (bounded) group of ``keys``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[pd.DataFrame] = []
        rows = 0
        for key, group in stream_groups(batches, keys):
            got = fn(key, group)
            if got is not None and len(got):
                out.append(got)
                rows += len(got)
            if rows > 20_000:
                yield pd.concat(out, ignore_index=True)
                out, rows = [], 0
        if out:
            yield pd.concat(out, ignore_index=True)
        give_back()

    # a given number: what small rows cost in Python isn't seen by their bytes, by which partitions would be joined
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *(extra_order or [])).mapInPandas(run, schema)


def union_find(pairs: Iterable[tuple[int, int]]) -> dict[int, int]:
    """Root (the smallest member) of every node named in ``pairs``."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def _local_stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spanning stars of what one task holds; at most one edge for each node that it saw."""

    def pairs() -> Iterator[tuple[int, int]]:
        for b in batches:
            yield from zip(b["u"].tolist(), b["v"].tolist(), strict=True)

    roots = [(x, r) for x, r in union_find(pairs()).items() if x != r]
    if roots:
        yield pd.DataFrame(roots, columns=["u", "v"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)`` that is not its component's smallest member.

    Alternating large-star and small-star rounds (Kiveris et al. 2014) after a task-local contraction.
    Minima are aggregates with map-side combine and joined back, so the centre of a huge star
    is a key of a splittable join, never one group in one task. Each round is a table in the shared folder.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = materialize(e.mapInPandas(_local_stars, "u long, v long").distinct(), "edges")
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = materialize(small.distinct(), "edges")
        roots = e.select(F.col("v").alias("u")).distinct()
        sizes = e.agg(F.count("u").alias("n"), F.countDistinct("u").alias("d")).first()
        if sizes["n"] == sizes["d"] and e.join(roots, "u", "left_semi").limit(1).count() == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
