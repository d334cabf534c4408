"""Array queries over the embeddings as a grid, and catalogues made inline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arrays as A
from .base import grid, query, table

DIMS = ["i0", "i1"]


@query("hyperslab", " SELECT i0, i1, round(value, 6) AS value FROM v_grid WHERE i0 >= 10 AND (i0 - 10) % 7 < 2 AND (i0 - 10) // 7 < 20 AND i1 >= 4 AND (i1 - 4) % 16 < 3 AND (i1 - 4) // 16 < 3", "v_grid")
def hyperslab(spark: SparkSession, sf: str) -> DataFrame:
    return grid(spark, sf).where(A.hyperslab([10, 4], [7, 16], [20, 3], [2, 3], DIMS)).withColumn("value", F.round("value", 6))


_WANTED = [(0, 5, 3), (1, 2, 60), (2, 5, 3), (3, 400, 0), (4, 99999999, 1)]


@query("point_select", ", w AS (SELECT * FROM (VALUES (0, 5, 3), (1, 2, 60), (2, 5, 3), (3, 400, 0), (4, 99999999, 1)) t(ordinal, i0, i1)) SELECT w.ordinal, w.i0, w.i1, round(value, 6) AS value FROM w LEFT JOIN v_grid g ON g.i0 = w.i0 AND g.i1 = w.i1", "v_grid")
def point_select(spark: SparkSession, sf: str) -> DataFrame:
    wanted = spark.createDataFrame(_WANTED, "ordinal long, i0 long, i1 long")
    return A.points(grid(spark, sf), wanted, DIMS).select("ordinal", "i0", "i1", F.round("value", 6).alias("value"))


@query("chunk_prune", " SELECT i0 // 50 AS c0, i1 // 16 AS c1, count(*) AS n FROM v_grid WHERE i0 // 50 BETWEEN 2 AND 4 AND i1 // 16 BETWEEN 1 AND 2 GROUP BY ALL", "v_grid")
def chunk_prune(spark: SparkSession, sf: str) -> DataFrame:
    return A.chunks_hit(grid(spark, sf), DIMS, [50, 16], [120, 20], [240, 40])


@query("selection_write", " SELECT i0, i1, round(CASE WHEN i0 BETWEEN 10 AND 19 AND i1 % 4 = 0 THEN -1.0 ELSE value END, 6) AS value FROM v_grid", "v_grid")
def selection_write(spark: SparkSession, sf: str) -> DataFrame:
    g = grid(spark, sf)
    return A.overwrite(g, g.where("i0 between 10 and 19 and i1 % 4 = 0").withColumn("value", F.lit(-1.0)), DIMS).withColumn("value", F.round("value", 6))


@query(
    "vds_assemble",
    """, g AS (SELECT * FROM range(30) a(i0), range(70) b(i1))
 SELECT g.i0, g.i1, round(coalesce(y.value, x.value, 0), 6) AS value FROM g LEFT JOIN v_grid x ON x.i0 = g.i0 AND x.i1 = g.i1 AND x.i0 < 10 LEFT JOIN v_grid y ON y.i0 - 92 = g.i0 AND y.i1 = g.i1 AND y.i0 BETWEEN 100 AND 109""",
    "v_grid",
)
def vds_assemble(spark: SparkSession, sf: str) -> DataFrame:
    g = grid(spark, sf)
    place = spark.range(30 * 70).select(F.floor(F.col("id") / 70).cast("long").alias("i0"), (F.col("id") % 70).alias("i1"))
    return A.virtual(place, [(g.where("i0 < 10"), [0, 0]), (None, [0, 0]), (g.where("i0 between 100 and 109"), [-92, 0])], DIMS).select("i0", "i1", F.round("value", 6).alias("value"))


@query("stripe_map", " SELECT l_orderkey AS byte_at, (l_orderkey // 100) % 4 AS file, (l_orderkey // 100) // 4 * 100 + l_orderkey % 100 AS place FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def stripe_map(spark: SparkSession, sf: str) -> DataFrame:
    at = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("byte_at")).distinct()
    f, p = A.stripe(F.col("byte_at"), 100, 4)
    return at.select("byte_at", f.alias("file"), p.alias("place"))


@query("cf_unpack", ", p AS (SELECT i0, i1, CASE WHEN i1 = 0 THEN -9999 ELSE CAST(round(value * 1000) AS BIGINT) END AS packed FROM v_grid) SELECT i0, i1, CASE WHEN packed = -9999 THEN 'nan' ELSE CAST(round(packed * 0.01::DOUBLE + 273.15::DOUBLE, 6) AS VARCHAR) END AS physical FROM p", "v_grid")
def cf_unpack(spark: SparkSession, sf: str) -> DataFrame:
    p = grid(spark, sf).select("i0", "i1", F.when(F.col("i1") == 0, -9999.0).otherwise(F.round(F.col("value") * 1000)).alias("packed"))
    u = A.cf_unpack(F.col("packed"), F.lit(0.01), F.lit(273.15), F.lit(-9999.0), F.lit(None).cast("double"))
    return p.select("i0", "i1", F.when(F.isnan(u), "nan").otherwise(F.round(u, 6).cast("string")).alias("physical"))


def catalog(spark: SparkSession) -> DataFrame:
    rows = [
        ("/lat", "dataset", "f64", [3], {"CLASS": "DIMENSION_SCALE", "_Netcdf4Dimid": "0", "units": "degrees_north", "valid_min": "-90", "valid_max": "90"}),
        ("/lon", "dataset", "f64", [4], {"CLASS": "DIMENSION_SCALE", "_Netcdf4Dimid": "1", "units": "degrees_east"}),
        ("/temperature", "dataset", "i16", [3, 4], {"scale_factor": "0.01", "add_offset": "273.15", "_FillValue": "-9999", "valid_range": "-5000,5000"}),
        ("/station/codes", "dataset", "u8", [5], {}),
        ("/station", "group", None, [], {"title": "stations"}),
    ]
    return spark.createDataFrame(rows, "path string, kind string, dtype string, shape array<long>, attrs map<string,string>")


@query("catalog_list", " SELECT * FROM (VALUES ('/lat', 1, 3, 'degrees_north'), ('/lon', 1, 4, 'degrees_east'), ('/temperature', 2, 12, NULL)) t(path, rank, elements, units)")
def catalog_list(spark: SparkSession, sf: str) -> DataFrame:
    top = catalog(spark).where((F.col("kind") == "dataset") & ~F.col("path").rlike("^/.+/"))
    return top.select("path", F.size("shape").alias("rank"), F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x).alias("elements"), F.col("attrs")["units"].alias("units"))


@query("nc_dimensions", " SELECT * FROM (VALUES ('/lat', 3, 0), ('/lon', 4, 1)) t(path, size, dimid)")
def nc_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    return A.dimensions(catalog(spark))


@query("cf_valid_range", " SELECT * FROM (VALUES ('/lat', -90.0, 90.0), ('/temperature', -5000.0, 5000.0)) t(path, lo, hi)")
def cf_valid_range(spark: SparkSession, sf: str) -> DataFrame:
    c = catalog(spark).select("path", A.valid_range(F.col("attrs")).alias("r")).where("r is not null")
    return c.select("path", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))


@query("nc_coordinates", " SELECT * FROM (VALUES ('/lat', true), ('/lon', true), ('/temperature', false)) t(path, is_coordinate)")
def nc_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    c = catalog(spark).where(F.col("path").isin("/lat", "/lon", "/temperature"))
    dims = [("lat", 3), ("lon", 4)]
    shapes = {r["path"]: A.axis_names(r["shape"], dims) for r in c.select("path", "shape").collect()}  # metadata of one file
    names = spark.createDataFrame(list(shapes.items()), "path string, dims array<string>")
    return c.join(names, "path").select("path", A.is_coordinate(F.col("path"), F.col("shape"), F.col("dims")).alias("is_coordinate"))


@query("enum_decode", " SELECT l_linenumber AS code, CASE l_linenumber WHEN 1 THEN 'first' WHEN 2 THEN 'second' WHEN 3 THEN 'third' ELSE 'UNKNOWN(0x' || l_linenumber || ')' END AS name, count(*) AS n FROM lineitem GROUP BY ALL")
def enum_decode(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("code"), A.enum_name(F.col("l_linenumber"), {1: "first", 2: "second", 3: "third"}).alias("name")).groupBy("code", "name").agg(F.count("*").alias("n"))


@query("compound_project", " SELECT p_partkey, p_size AS size, round(p_retailprice, 2) AS price FROM part")
def compound_project(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "part").select("p_partkey", F.struct(F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), F.col("p_name").alias("name")).alias("c"))
    return s.select("p_partkey", F.col("c.size").alias("size"), F.round("c.price", 2).alias("price"))


_KINDS = ["i8", "i16", "i32", "i64", "u8", "u16", "u32", "u64", "f32", "f64"]


@query(
    "conversion_cost",
    """, k AS (SELECT unnest(['i8', 'i16', 'i32', 'i64', 'u8', 'u16', 'u32', 'u64', 'f32', 'f64']) AS t), p AS (SELECT a.t AS source, b.t AS target, a.t[1] AS ks, b.t[1] AS kt, CAST(a.t[2:] AS INT) AS bs, CAST(b.t[2:] AS INT) AS bt FROM k a, k b)
 SELECT source, target, CASE WHEN source = target THEN 'None' WHEN ks = kt THEN CASE WHEN bt > bs THEN 'Widening' ELSE 'Narrowing' END WHEN ks = 'u' AND kt = 'i' AND bt > bs THEN 'Widening' WHEN kt = 'f' AND bs <= CASE bt WHEN 64 THEN 53 ELSE 24 END THEN 'Widening' ELSE 'Lossy' END AS cost FROM p""",
)
def conversion_cost(spark: SparkSession, sf: str) -> DataFrame:
    k = spark.createDataFrame([(a, b) for a in _KINDS for b in _KINDS], "source string, target string")
    return k.select("source", "target", A.conversion_cost(F.col("source"), F.col("target")).alias("cost"))


@query("typed_read", " SELECT event_id, CAST(trunc(value) AS BIGINT) AS as_i64, round(CAST(value AS FLOAT)::DOUBLE, 3) AS as_f32, TRY_CAST(props AS BIGINT) AS from_text FROM events")
def typed_read(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", F.col("value").cast("long").alias("as_i64"), F.round(F.col("value").cast("float").cast("double"), 3).alias("as_f32"), F.col("props").try_cast("long").alias("from_text"))


@query("dict_encode", ", f AS (SELECT source AS value, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY source) SELECT value, row_number() OVER (ORDER BY first, value) - 1 AS code, n FROM f")
def dict_encode(spark: SparkSession, sf: str) -> DataFrame:
    return A.dict_encode(table(spark, sf, "documents"), "source", "doc_id")


@query("dict_benefit", ", a AS (SELECT count(*) AS n, count(DISTINCT source) AS u, sum(strlen(source)) AS p FROM documents), d AS (SELECT sum(strlen(source)) AS db FROM (SELECT DISTINCT source FROM documents)) SELECT n, u AS n_unique, round(p / (db + 4 * n), 6) AS ratio, n >= 4 AND u / n <= 0.75 AND p / (db + 4 * n) > 1 AS beneficial FROM a, d")
def dict_benefit(spark: SparkSession, sf: str) -> DataFrame:
    return A.dict_benefit(table(spark, sf, "documents"), "source").withColumn("ratio", F.round("ratio", 6))


@query(
    "sweep_detect",
    """, d AS (SELECT l_suppkey % 20 AS reader, l_orderkey - lag(l_orderkey) OVER w AS d0, l_linenumber - lag(l_linenumber) OVER w AS d1 FROM lineitem WINDOW w AS (PARTITION BY l_suppkey % 20 ORDER BY l_orderkey * 100 + l_linenumber)),
 m AS (SELECT reader, count(*) FILTER (WHERE d0 <> 0) AS n0, count(*) FILTER (WHERE d1 <> 0) AS n1, sum(d0) AS s0, sum(d1) AS s1 FROM d GROUP BY reader)
 SELECT reader, CASE WHEN n0 >= n1 THEN 0 ELSE 1 END AS axis, greatest(n0, n1) AS moves, CASE WHEN n0 >= n1 THEN CAST(trunc(s0 / n0) AS BIGINT) ELSE CAST(trunc(s1 / n1) AS BIGINT) END AS step FROM m WHERE greatest(n0, n1) > 0""",
)
def sweep_detect(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 20).alias("reader"), F.col("l_orderkey").alias("x"), F.col("l_linenumber").alias("y"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("at"))
    return A.sweeps(a, ["x", "y"], "reader", "at")


@query("sequential_reads", ", s AS (SELECT o_custkey % 30 AS reader, (o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey % 30 ORDER BY o_orderkey)) = 30 AS seq FROM orders) SELECT reader, count(*) AS n, count(*) FILTER (WHERE seq) AS n_sequential FROM s GROUP BY reader")
def sequential_reads(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 30).alias("reader"), F.col("o_orderkey").alias("offset"))
    return A.sequential(o, "reader", "offset", 30)


@query("lane_partition", " SELECT mem_id, (row_number() OVER (ORDER BY mem_id) - 1) % 8 AS lane FROM v_memory", "v_memory")
def lane_partition(spark: SparkSession, sf: str) -> DataFrame:
    from .base import memory

    return A.balanced_lanes(memory(spark, sf).select("mem_id"), ["mem_id"], 8)


@query("multi_read", " SELECT 0 AS ordinal, 'orders' AS name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders UNION ALL SELECT 1, 'part', count(*), round(sum(p_retailprice), 2) FROM part")
def multi_read(spark: SparkSession, sf: str) -> DataFrame:
    """Several datasets in the order asked for."""
    one = lambda k, t, c: table(spark, sf, t).agg(F.count("*").alias("n"), F.round(F.sum(c), 2).alias("total")).select(F.lit(k).alias("ordinal"), F.lit(t).alias("name"), "n", "total")
    return one(0, "orders", "o_totalprice").unionByName(one(1, "part", "p_retailprice"))
