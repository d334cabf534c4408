import sqlite3
import struct

from pyspark.sql import functions as F

from mnemoria.sources.arrays import ArrayStore
from mnemoria.sources.sqlite import SqliteSource, floats


def test_array_store_round_trip_and_pruning(spark, tmp_path):
    s = ArrayStore(spark, f"file://{tmp_path}/store")
    v = spark.range(100).select(F.floor(F.col("id") / 10).cast("long").alias("i0"), (F.col("id") % 10).alias("i1"), F.col("id").cast("double").alias("value"))
    s.group("/g", {"title": "t"})
    s.write("/g/x", v, [10, 10], [5, 5], attrs={"units": "K"})
    assert s.read("/g/x").count() == 100
    part = s.select("/g/x", [1, 0], [2, 1], [2, 1], [1, 2])
    assert sorted((r["i0"], r["i1"], r["value"]) for r in part.collect()) == [(1, 0, 10.0), (1, 1, 11.0), (3, 0, 30.0), (3, 1, 31.0)]
    plan = part._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(c0" in plan or "c0#" in plan.split("PartitionFilters")[1]
    assert [r["path"] for r in s.children("/g").collect()] == ["/g/x"]
    assert s.duplicates().count() == 0


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "m.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE memory_chunks (id INTEGER PRIMARY KEY, chunk TEXT, embedding BLOB, deleted INTEGER)")
        c.executemany("INSERT INTO memory_chunks VALUES (?, ?, ?, ?)", [(i, f"c{i}", struct.pack("<2f", i, 0.5), i % 3 == 0) for i in range(1, 51)])
    spark.dataSource.register(SqliteSource)
    df = spark.read.format("sqlite").option("path", path).option("table", "memory_chunks").load()
    assert df.rdd.getNumPartitions() == 4
    live = df.where("deleted = 0").select("id", "chunk", floats(F.col("embedding")).alias("v"))
    got = {r["id"]: r["v"] for r in live.collect()}
    assert len(got) == 34 and got[1] == [1.0, 0.5]
    later = spark.read.format("sqlite").option("path", path).option("table", "memory_chunks").option("after", "40").load()
    assert later.count() == 10
