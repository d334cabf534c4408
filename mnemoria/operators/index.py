"""Persisted search indexes: documents' terms, postings, vectors with their norms, and what ranking needs, as Parquet laid out by what queries ask for.

An index is written once and read by any number of queries and sessions. Postings lie in folders by a hash of the term, in the order of terms, so a
query opens the folders of its own terms and skips all row groups of others.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vectors
from . import retrieval as R

BUCKETS = 64


class SearchIndex:
    """``cuts(id, dl, terms, tfs)``, ``postings(term, id, tf, dl)``, ``terms(term, df)``, ``vectors(id, embedding, norm)``, ``rows(id, ...)`` and two totals."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        totals = spark.read.parquet(f"{folder}/totals").first()
        self.n_docs, self.avgdl = totals["n_docs"], totals["avgdl"]

    @classmethod
    def build(cls, memory: DataFrame, folder: str, id_col: str = "mem_id", keep: tuple[str, ...] = ("activation", "source_channel", "timestamp"), buckets: int = BUCKETS, texts: DataFrame | None = None) -> SearchIndex:
        """Texts are cut once, each by itself, and written before their terms are dealt. A term that is in most documents has a folder with several files: its rows are dealt by size.

        ``texts`` are the same rows without vectors, for who can give them without a join by which texts would be sorted.
        """
        rows = R.active(memory)
        plain = rows if texts is None else R.active(texts)
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
        spark = memory.sparkSession
        R.cuts(plain, id_col).write.parquet(f"{folder}/cuts")
        pair = F.explode(F.arrays_zip("terms", "tfs")).alias("x")
        each = spark.read.parquet(f"{folder}/cuts").select("id", "dl", pair).select(F.col("x.terms").alias("term"), "id", F.col("x.tfs").alias("tf"), "dl")
        laid = each.select("term", "id", "tf", "dl", bucket).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
        laid.write.partitionBy("bucket").parquet(f"{folder}/postings")
        postings = spark.read.parquet(f"{folder}/postings")
        terms = postings.groupBy("bucket", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("times"))
        terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{folder}/terms")
        held = rows.where(F.col("embedding").isNotNull()).select(F.col(id_col).alias("id"), "embedding", vectors.norm(F.col("embedding")).alias("norm"))
        held.write.parquet(f"{folder}/vectors")
        plain.select(F.col(id_col).alias("id"), *keep).write.parquet(f"{folder}/rows")
        tokens = spark.read.parquet(f"{folder}/terms").agg(F.coalesce(F.sum("times"), F.lit(0)).alias("t"))
        n = spark.read.parquet(f"{folder}/rows").count()
        tokens.select(F.lit(n).cast("long").alias("n_docs"), (F.col("t") / F.lit(float(n) if n else None)).alias("avgdl")).coalesce(1).write.parquet(f"{folder}/totals")
        return cls(spark, folder)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _asked(self, name: str, terms: list[str]) -> DataFrame:
        folders = [r["b"] for r in self.spark.createDataFrame([(t,) for t in terms] or [("",)], "term string").select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()]
        return self._read(name).where(F.col("bucket").isin(folders) & F.col("term").isin(terms))

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """Documents that hold each term; a row for each term of one query reaches the driver."""
        found = {r["term"]: r["df"] for r in self._asked("terms", terms).select("term", "df").collect()}
        return {t: found.get(t, 0) for t in terms}

    def bm25_parts(self, query: str) -> DataFrame:
        """``(id, part)``: what each term of the query adds to a document's score."""
        times = Counter(R.query_terms(query))
        df = self.frequencies(list(times))
        known = [t for t in times if df[t]]
        if not known:
            return self.spark.createDataFrame([], "id long, part double")
        weight = F.create_map(*[x for t in known for x in (F.lit(t), times[t] * F.log(F.lit((self.n_docs - df[t] + 0.5) / (df[t] + 0.5) + 1)))])
        tf, length = F.col("tf").cast("double"), F.col("dl") / F.lit(self.avgdl)
        part = F.element_at(weight, F.col("term")) * tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * length))
        return self._asked("postings", known).select("id", part.alias("part"))

    def bm25(self, query: str) -> DataFrame:
        return self.bm25_parts(query).groupBy("id").agg(F.sum("part").alias("score"))

    def bm25_batch(self, queries: DataFrame, k: int, places: int | None = None) -> DataFrame:
        """``(query_id, id, score, rank)`` for ``queries(query_id, text)``, which are sent to the documents' terms."""
        return R.bm25_batch(self._read("cuts"), self.n_docs, self.avgdl, self._read("terms").select("term", "df"), queries, k, places)

    def cosine(self, query: list[float]) -> DataFrame:
        """``(id, score)`` of all vectors, from their stored norms; nothing for a zero query."""
        q = vectors.literal(query)
        length = sum(x * x for x in query) ** 0.5
        rows = self._read("vectors").where(F.lit(any(query)) & (F.size("embedding") == len(query)))
        return rows.select("id", vectors.cosine_given_norms(F.col("embedding"), q, F.col("norm"), F.lit(length)).alias("score"))

    def rows(self) -> DataFrame:
        return self._read("rows")

    def fused(self, query_text: str, query: list[float], pool: int | None = None, vector_weight: float = 0.7, keyword_weight: float = 0.3) -> DataFrame:
        """``(id, score)``: both lists in one exchange by id; terms' parts are added up there too."""
        vec = self.cosine(query)
        if pool:
            vec = R.top(vec, pool)
        return R.fuse_parts(vec, self.bm25_parts(query_text), vector_weight, keyword_weight)

    def search(self, query_text: str, query: list[float], k: int, now: float) -> DataFrame:
        """The whole path of a search: hybrid candidates, re-ranking, rejection, the best k."""
        wanted = max(3 * k, 10)
        best = R.top(self.fused(query_text, query, max(8 * wanted, 64)).withColumn("score", F.round("score", 9)), wanted)
        hits = self.rows().join(F.broadcast(best.withColumnRenamed("score", "fused")), "id")  # at most ``wanted`` rows
        return R.top(R.reject(R.rerank(hits, now)), k)
