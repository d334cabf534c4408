"""Values of nested JSON arrays, flattened in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flat_numbers(json: Column) -> Column:
    """``array<double>`` of all numbers in a JSON array of any depth. Brackets of numbers carry no more than their order."""
    found = F.regexp_extract_all(json, F.lit(r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"), F.lit(0))
    return F.transform(found, lambda x: x.cast("double"))
