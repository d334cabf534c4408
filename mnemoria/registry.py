"""Names of the engine's own queries, their builders and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import ann, arrays, base, codecs, graph, integrity, retrieval, store, strategy, streams, temporal, text, tiers  # noqa: F401

FLAGSHIP = "hybrid_weighted_topk"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
