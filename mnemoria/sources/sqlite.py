"""A SQLite table as a Spark source, read in ranges of its row ids.

Register with ``spark.dataSource.register(SqliteSource)`` and read with ``spark.read.format("sqlite").option("path", ...).option("table", ...)``.
"""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_TYPES = {"INTEGER": "bigint", "REAL": "double", "TEXT": "string", "BLOB": "binary"}


class Range(InputPartition):
    def __init__(self, lo: int, hi: int) -> None:
        self.lo, self.hi = lo, hi


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SqliteSource(DataSource):
    """Options: path, table, partitions (4), after (rows with a larger id only)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _columns(self) -> list[tuple[str, str]]:
        with sqlite3.connect(self.options["path"]) as c:
            return [(r[1], r[2].upper()) for r in c.execute(f"PRAGMA table_info({_quoted(self.options['table'])})")]

    def schema(self) -> str:
        return ", ".join(f"`{n}` {_TYPES.get(t, 'string')}" for n, t in self._columns())

    def reader(self, schema: object) -> DataSourceReader:
        return SqliteReader(dict(self.options), [n for n, _ in self._columns()])


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]) -> None:
        self.options, self.columns = options, columns

    def partitions(self) -> list[InputPartition]:
        after = int(self.options.get("after", -1))
        with sqlite3.connect(self.options["path"]) as c:
            lo, hi = c.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.options['table'])} WHERE rowid > ?", (after,)).fetchone()
        if lo is None:
            return []
        n = int(self.options.get("partitions", 4))
        step = -(-(hi - lo + 1) // n)
        return [Range(a, min(a + step, hi + 1)) for a in range(lo, hi + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        names = ", ".join(map(_quoted, self.columns))
        with sqlite3.connect(self.options["path"]) as c:
            yield from c.execute(f"SELECT {names} FROM {_quoted(self.options['table'])} WHERE rowid >= ? AND rowid < ?", (partition.lo, partition.hi))


def floats(blob: Column) -> Column:
    """Little-endian 32-bit floats of a blob."""
    import pandas as pd

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else list(struct.unpack(f"<{len(x) // 4}f", bytes(x)[: len(x) // 4 * 4])))

    return F.pandas_udf(run, "array<float>", F.PandasUDFType.SCALAR)(blob)
