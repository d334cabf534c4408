"""Approximate vector search: inverted lists, product quantisation, graphs within partitions."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors
from . import best
from .best import matrix, unit

#: Rows that columns are computed for at once.
ROWS = 1024


def with_columns(rows: DataFrame, make: Callable[[np.ndarray], dict[str, np.ndarray | list]], schema: str, v: str = "embedding") -> DataFrame:
    """``rows`` that have a vector, with columns computed from a matrix of them; all other columns pass through as they are."""
    more = T.StructType.fromDDL(schema)
    own = rows.where(F.col(v).isNotNull())
    out = T.StructType([*own.schema.fields, *more.fields])
    kinds = {"int": pa.int32(), "array<int>": pa.list_(pa.int32()), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                vec = b.column(b.schema.get_field_index(v))
                parts = [make(matrix(vec.slice(at, ROWS))) for at in range(0, len(b), ROWS)]
                cols = [pa.array([x for p in parts for x in p[f.name]] if f.dataType.typeName() == "array" else np.concatenate([p[f.name] for p in parts]), kinds[f.dataType.simpleString()]) for f in more.fields]
                yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=out.names)

    return own.mapInArrow(run, out)


def nearest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """(rows, n): the centres with the largest cosine, the first of equals; scores count to twelve places."""
    return np.argsort(-np.round(unit(x) @ unit(centres).T, 12), axis=1, kind="stable")[:, :n]


def assign(rows: DataFrame, centroids: list[list[float]], v: str = "embedding") -> DataFrame:
    """``cluster``: the centroid with the largest cosine, the first of equals."""
    sent = rows.sparkSession.sparkContext.broadcast(np.array(centroids, np.float64))
    return with_columns(rows, lambda x: {"cluster": nearest(x, sent.value)[:, 0].astype(np.int32)}, "cluster int", v)


def first_by_hash(rows: DataFrame, n: int, id_col: str, v: str = "embedding") -> np.ndarray:
    """At most ``n`` vectors, those whose ids have the smallest hashes: the seeds of a fit, or its bounded sample."""
    got = rows.where(F.col(v).isNotNull()).select(id_col, v).orderBy(F.md5(F.col(id_col).cast("string")), id_col).limit(n).select(v).collect()
    return np.array([r[0] for r in got], np.float64)


def kmeans(rows: DataFrame, k: int, iterations: int = 5, v: str = "embedding", id_col: str = "vec_id") -> list[list[float]]:
    """Cosine k-means. Every step is one pass over all rows that sums each cluster in the tasks; k sums of each task are added up, and k vectors reach the driver."""
    centres = first_by_hash(rows, k, id_col, v)
    for _ in range(iterations if len(centres) else 0):
        sent = rows.sparkSession.sparkContext.broadcast(centres)

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            c = sent.value
            total, count = np.zeros_like(c), np.zeros(len(c), np.int64)
            for b in batches:
                for at in range(0, len(b), ROWS):
                    x = matrix(b.column(0).slice(at, ROWS))
                    own = nearest(x, c)[:, 0]
                    np.add.at(total, own, x)
                    np.add.at(count, own, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c), dtype=np.int32)), pa.array(count), pa.array(list(total), pa.list_(pa.float64()))], names=["cluster", "n", "total"])

        parts = rows.where(F.col(v).isNotNull()).select(v).mapInArrow(sums, "cluster int, n long, total array<double>")
        dims = centres.shape[1]
        got = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"d{i}") for i in range(dims)]).collect()
        sent.unpersist()
        centres = centres.copy()
        for r in got:
            if r["n"]:
                centres[r["cluster"]] = np.array([r[f"d{i}"] for i in range(dims)]) / r["n"]
    return centres.tolist()


def rairs_lists(x: np.ndarray, centres: np.ndarray, copies: int = 2, mix: float = 0.7) -> np.ndarray:
    """(rows, copies): a vector's nearest list, then those where nearness and direction together say it lies at the border.

    Direction is the cosine of what the centroid leaves of the vector with the way from the vector to the middle of all centroids.
    """
    near = unit(x) @ unit(centres).T
    own = np.round(near, 12).argmax(1)
    toward = unit(centres.mean(0) - x)
    rest = unit(x[:, None, :] - centres[None])
    score = np.round(mix * near + (1 - mix) * np.einsum("ncd,nd->nc", rest, toward), 12)
    score[np.arange(len(x)), own] = np.inf
    return np.argsort(-score, axis=1, kind="stable")[:, :copies]


def rairs_assign(rows: DataFrame, centroids: list[list[float]], copies: int = 2, mix: float = 0.7) -> DataFrame:
    """A row for each list of a vector, by ``rairs_lists``."""
    sent = rows.sparkSession.sparkContext.broadcast(np.array(centroids, np.float64))
    several = with_columns(rows, lambda x: {"_lists": rairs_lists(x, sent.value, copies, mix)}, "_lists array<int>")
    return several.withColumn("cluster", F.explode("_lists")).drop("_lists")


def pq_train(sample: np.ndarray, parts: int, codes: int, iterations: int = 5) -> np.ndarray:
    """Codebooks (parts, codes, dims) by k-means on each slice of a bounded sample; the first rows are the seeds, distances count to twelve places."""
    width = sample.shape[1] // parts
    books = np.stack([sample[:codes, p * width : (p + 1) * width].copy() for p in range(parts)])
    for p in range(parts):
        x = sample[:, p * width : (p + 1) * width]
        for _ in range(iterations):
            own = _words(x, books[p])
            for c in np.unique(own):
                books[p][c] = x[own == c].mean(0)
    return books


def pq_fit(rows: DataFrame, parts: int, codes: int, iterations: int = 5, v: str = "embedding", id_col: str = "vec_id") -> np.ndarray:
    """As ``pq_train``, over all rows: a step is one pass that sums the slices of each code word in the tasks. The first rows by a hash of the id are the seeds."""
    seeds = first_by_hash(rows, codes, id_col, v)
    books = pq_train(seeds, parts, codes, 0)
    width = books.shape[2]
    for _ in range(iterations):
        sent = rows.sparkSession.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            books = sent.value
            n, size = books.shape[1], books.shape[0] * books.shape[1]
            total, count = np.zeros((size, width)), np.zeros(size, np.int64)
            for b in batches:
                for at in range(0, len(b), ROWS):
                    x = matrix(b.column(0).slice(at, ROWS))
                    word = (pq_codes(x, books) + np.arange(parts) * n).ravel()
                    count += np.bincount(word, minlength=size)
                    for i in range(width):
                        total[:, i] += np.bincount(word, x[:, i : parts * width : width].ravel(), size)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(count), pa.array(list(total), pa.list_(pa.float64()))], names=["word", "n", "total"])

        each = rows.where(F.col(v).isNotNull()).select(v).mapInArrow(sums, "word int, n long, total array<double>")
        got = each.groupBy("word").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"d{i}") for i in range(width)]).where("n > 0").collect()  # a row for each code word
        sent.unpersist()
        books = books.copy()
        for r in got:
            books[divmod(r["word"], books.shape[1])] = np.array([r[f"d{i}"] for i in range(width)]) / r["n"]
    return books


def _words(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.round(((x[:, None, :] - book[None]) ** 2).sum(-1), 12).argmin(1)


def pq_codes(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    width = books.shape[2]
    return np.stack([_words(x[:, p * width : (p + 1) * width], b) for p, b in enumerate(books)], axis=1)


def pq_encode(rows: DataFrame, books: np.ndarray, v: str = "embedding") -> DataFrame:
    """``codes``: for each slice the nearest code word, the first of equals."""
    sent = rows.sparkSession.sparkContext.broadcast(np.asarray(books, np.float64))
    return with_columns(rows, lambda x: {"codes": pq_codes(x, sent.value)}, "codes array<int>", v)


def search(index: DataFrame, queries: DataFrame, k: int, centroids: np.ndarray | None = None, n_probe: int = 0, books: np.ndarray | None = None, candidates: int = 0, copies: int = 1, id_col: str = "vec_id") -> DataFrame:
    """``(query_id, id, score)``: the best k by cosine for each of ``queries(query_id, embedding)``, a stated set, from a stored index.

    With ``centroids``, a query looks into the lists of its ``n_probe`` nearest ones, and lists that none asks for aren't read (``index`` is laid out
    by ``cluster``). With ``books``, the ``candidates`` nearest by ``codes`` are ranked by their cosine. Queries are sent in blocks of 4,096;
    a task multiplies matrices of a few MB and gives its best of each query. A vector that stands in as many lists as ``copies`` counts once.
    """
    spark = index.sparkSession
    out: DataFrame | None = None
    asked = queries.where("embedding is not null").select("query_id", "embedding").toLocalIterator()
    while block := list(islice(asked, 4096)):
        ids, q = np.array([r["query_id"] for r in block], np.int64), np.array([r["embedding"] for r in block], np.float64)
        own, probed = index, None
        if centroids is not None:
            near = nearest(q, centroids, n_probe)
            probed = np.zeros((len(q), len(centroids)), bool)
            np.put_along_axis(probed, near, True, 1)
            own = own.where(F.col("cluster").isin(np.unique(near).tolist()))
        tables = None
        if books is not None:
            width = books.shape[2]
            tables = np.stack([((q[:, None, p * width : (p + 1) * width] - b[None]) ** 2).sum(-1) for p, b in enumerate(books)])
        sent = spark.sparkContext.broadcast((ids, unit(q), probed, tables))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            ids, q, probed, tables = sent.value
            found = best.Best(len(q), candidates or k, copies)
            for b in batches:
                for at in best.slices(len(b), len(q)):
                    own = b.slice(at.start, at.stop - at.start)
                    x = unit(matrix(own.column(1)))
                    if tables is None:
                        far = -(q @ x.T)
                    else:
                        codes = matrix(own.column(own.schema.get_field_index("codes"))).astype(np.int64)
                        far = np.round(sum(t[:, codes[:, p]] for p, t in enumerate(tables)), 9)
                    if probed is not None:
                        far[~probed[:, own.column(own.schema.get_field_index("cluster")).to_numpy()]] = np.inf
                    r, c = found.within(far, best.SLACK if tables is None else 0.0)
                    score = best.cosines(q, x, r, c)
                    found.add(r, best.numbers(own.column(0))[c], -score if tables is None else far[r, c], score)
            yield found.batch(ids)

        columns = [id_col, "embedding", *(["cluster"] if centroids is not None else []), *(["codes"] if books is not None else [])]
        part = own.where("embedding is not null").select(F.col(id_col).cast("long").alias("id"), *columns[1:]).mapInArrow(run, "query_id long, id long, far double, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, id long, score double")
    out = out.dropDuplicates(["query_id", "id"])
    if books is not None:
        near = Window.partitionBy("query_id").orderBy("far", "id")
        out = out.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= candidates)
    return multi_rank(out, ["query_id"]).where(F.col("rank") <= k).select("query_id", "id", "score")


class HNSW:
    """A layered neighbour graph over unit vectors, for the rows of one task."""

    def __init__(self, x: np.ndarray, m: int = 12, ef: int = 64) -> None:
        self.x, self.m, self.ef = unit(x), m, ef
        self.level = [self._level(i) for i in range(len(x))]
        self.links: list[list[list[int]]] = [[[] for _ in range(n + 1)] for n in self.level]
        self.entry = -1
        for i in range(len(x)):
            self._insert(i)

    @staticmethod
    def _level(i: int) -> int:
        z = (i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        z = (z ^ z >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
        u = ((z ^ z >> 31) >> 11) / float(1 << 53)
        return min(8, int(-np.log(max(u, 1e-12)) / np.log(12)))

    def _near(self, q: np.ndarray, start: list[int], level: int, ef: int) -> list[tuple[float, int]]:
        import heapq

        seen = set(start)
        sims = self.x[start] @ q
        todo = [(-s, i) for s, i in zip(sims.tolist(), start, strict=True)]
        best = [(s, i) for s, i in zip(sims.tolist(), start, strict=True)]
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            s, i = heapq.heappop(todo)
            if len(best) >= ef and -s < best[0][0]:
                break
            new = [j for j in self.links[i][level] if j not in seen]
            if not new:
                continue
            seen.update(new)
            for sj, j in zip((self.x[new] @ q).tolist(), new, strict=True):
                if len(best) < ef or sj > best[0][0]:
                    heapq.heappush(todo, (-sj, j))
                    heapq.heappush(best, (sj, j))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted(best, reverse=True)

    def _insert(self, i: int) -> None:
        if self.entry < 0:
            self.entry = i
            return
        at = [self.entry]
        top = self.level[self.entry]
        for level in range(top, self.level[i], -1):
            at = [self._near(self.x[i], at, level, 1)[0][1]]
        for level in range(min(top, self.level[i]), -1, -1):
            found = self._near(self.x[i], at, level, self.ef)
            at = [j for _, j in found]
            for j in at[: self.m]:
                self.links[i][level].append(j)
                own = self.links[j][level]
                own.append(i)
                most = 2 * self.m if level == 0 else self.m
                if len(own) > most:
                    sims = self.x[own] @ self.x[j]
                    self.links[j][level] = [own[k] for k in np.argsort(-sims, kind="stable")[:most]]
        if self.level[i] > top:
            self.entry = i

    def search(self, q: np.ndarray, k: int) -> list[tuple[int, float]]:
        if self.entry < 0:
            return []
        q = unit(q)
        at = [self.entry]
        for level in range(self.level[self.entry], 0, -1):
            at = [self._near(q, at, level, 1)[0][1]]
        return [(j, s) for s, j in self._near(q, at, 0, max(self.ef, k))[:k]]


def hnsw_build(rows: DataFrame, folder: str, shard: int = 20_000, id_col: str = "vec_id") -> DataFrame:
    """Graphs of at most ``shard`` rows each, written as rows ``(ids, graph)`` of a table in ``folder``. A deleted row never enters a graph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def graph() -> pa.RecordBatch:
            ids, x = np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([pickle.dumps(HNSW(x), protocol=5)], pa.binary())], names=["ids", "graph"])

        for b in batches:
            for at in range(0, len(b), shard):
                part = b.slice(at, shard)
                held.append((part.column(0).to_numpy(), matrix(part.column(1))))
                size += len(part)
                if size >= shard:
                    yield graph()
                    held, size = [], 0
        if size:
            yield graph()

    rows.where("embedding is not null").select(F.col(id_col).cast("long"), "embedding").mapInArrow(run, "ids array<long>, graph binary").write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def hnsw_search(graphs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, id, score)``: the best k of all graphs for each of ``queries(query_id, embedding)``, a stated set in blocks."""
    spark = graphs.sparkSession
    out: DataFrame | None = None
    asked = queries.where("embedding is not null").select("query_id", "embedding").toLocalIterator()
    while block := list(islice(asked, 4096)):
        sent = spark.sparkContext.broadcast(([int(r["query_id"]) for r in block], [np.array(r["embedding"], np.float64) for r in block]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for b in batches:
                for ids, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    graph = pickle.loads(body)
                    found = [(q, ids[j], s) for q, v in zip(*sent.value, strict=True) for j, s in graph.search(v, k)]
                    if found:
                        yield pa.RecordBatch.from_pandas(pd.DataFrame(found, columns=["query_id", "id", "score"]), preserve_index=False)

        part = graphs.select("ids", "graph").mapInArrow(run, "query_id long, id long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, id long, score double")
    return multi_rank(out, ["query_id"]).where(F.col("rank") <= k).drop("rank")


def by_modality(records: DataFrame, query: list[float], modality: str | None, k: int) -> DataFrame:
    """Best k records by their best embedding, of one modality or of any."""
    e = records.select("id", F.explode("embeddings").alias("e"))
    if modality is not None:
        e = e.where(F.col("e.modality") == modality)
    s = e.select("id", vectors.cosine(F.col("e.embedding"), vectors.literal(query)).alias("score"))
    return s.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def strategy(n: Column, blas: bool = True, parallel: bool = True, gpu: bool = False, accelerate: bool = False) -> Column:
    """Which scan suits so many rows on such a machine."""
    fast = "accelerate" if accelerate else "blas" if blas else None
    large = fast or ("gpu" if gpu else "ivf_pq")
    middle = fast or ("parallel" if parallel else "gpu" if gpu else "simd")
    return F.when(n > 500_000, "ivf_pq").when(n > 50_000, large).when(n > 10_000, middle).when(n >= 1_000, fast or "simd").otherwise("scalar")


def multi_rank(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id")))
