"""Array files: a folder of Parquet chunks with a catalogue, hierarchical by path.

A dataset of any rank is stored in long form with a column for each chunk coordinate, by which files are laid out, so that a selection
reads the chunks it touches. The catalogue holds kind, type, shape, chunk shape and attributes of every node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.arrays import chunk_of, hyperslab

CATALOG = "path string, kind string, dtype string, shape array<long>, chunk array<long>, attrs map<string,string>"


class ArrayStore:
    """Hierarchical datasets under one folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self, path: str) -> str:
        return f"{self.root}/data/{path.strip('/').replace('/', '__')}"

    def write(self, path: str, values: DataFrame, shape: list[int], chunk: list[int], dtype: str = "f64", attrs: dict[str, str] | None = None, codec: str = "zstd") -> None:
        """``values(i0, ..., value)``; one file for each chunk that has values."""
        dims = [f"i{k}" for k in range(len(shape))]
        ids = chunk_of(dims, chunk)
        names = [f"c{k}" for k in range(len(shape))]
        laid = values.select(*dims, "value", *ids)
        laid.repartition(*names).sortWithinPartitions(*names, *dims).write.mode("overwrite").option("compression", codec).partitionBy(*names).parquet(self._files(path))
        self._add([(path, "dataset", dtype, shape, chunk, attrs or {})])

    def group(self, path: str, attrs: dict[str, str] | None = None) -> None:
        self._add([(path, "group", None, [], [], attrs or {})])

    def _add(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, CATALOG).coalesce(1).write.mode("append").parquet(f"{self.root}/catalog")

    def catalog(self) -> DataFrame:
        return self.spark.read.schema(CATALOG).parquet(f"{self.root}/catalog")

    def duplicates(self) -> DataFrame:
        """Paths that were written more than once."""
        return self.catalog().groupBy("path").agg(F.count("*").alias("n")).where("n > 1")

    def children(self, path: str = "/") -> DataFrame:
        base = path.rstrip("/") + "/"
        return self.catalog().where(F.startswith("path", F.lit(base)) & ~F.contains(F.expr(f"substring(path, {len(base) + 1})"), F.lit("/")))

    def read(self, path: str) -> DataFrame:
        return self.spark.read.parquet(self._files(path))

    def select(self, path: str, start: list[int], stride: list[int], count: list[int], block: list[int]) -> DataFrame:
        """A regular selection; chunks outside of its box are pruned by their folders."""
        node = self.catalog().where(F.col("path") == path).first()
        dims = [f"i{k}" for k in range(len(node["shape"]))]
        out = self.read(path)
        for k, n in enumerate(node["chunk"]):
            last = start[k] + (count[k] - 1) * stride[k] + block[k] - 1
            out = out.where(F.col(f"c{k}").between(start[k] // n, last // n))
        return out.where(hyperslab(start, stride, count, block, dims)).select(*dims, "value")
