"""Running sums within an array, in DataFrame functions, in time that grows with its length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers of one block: appending copies an array, so arrays that are appended to stay short.
BLOCK = 256


def starts(lengths: Column) -> Column:
    """For each of ``lengths`` (array<int>, a column of its own) the sum of those before it, array<int>; null for null."""
    n = F.ceil(F.size(lengths) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))

    def within(acc: Column, block: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(acc["at"].alias("at"), F.array().cast("array<int>").alias("out")),
            lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
            lambda a: F.struct(a["at"].alias("at"), F.concat(acc["out"], F.array(a["out"])).alias("out")),
        )

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    return F.aggregate(blocks, first, within, lambda acc: F.flatten(acc["out"]))
