"""From raw documents to packed token sequences: the stages, and their composition.

Each stage takes (spark, docs, sf_dir), decides over all rows it is given, and returns what it keeps; ``run`` writes each
stage's rows as Parquet in the shared folder and gives the next one those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoria.llm.decontaminate import drop_leaks
from mnemoria.llm.language import keep_known
from mnemoria.llm.lines import EVERY_LINE, drop_recurring
from mnemoria.llm.packing import op8_packing
from mnemoria.llm.shared import materialize, table
from mnemoria.llm.simhash import keep_one_of_each


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a known language stay, whatever their ids."""
    return keep_known(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs across documents go from all but the first; every document stays."""
    done = drop_recurring(docs, min_tokens=EVERY_LINE, counts=None)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id stays, rows without an id last."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a test item go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its ids' place and checksum, its sequence and offset."""
    return op8_packing(spark, sf_dir, docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Language ID trains a network and packing runs a tokenizer: SQL expresses neither. Tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
