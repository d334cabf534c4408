"""Entities, query expansion, Markdown and nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract as X
from ..operators import graph as G
from ..sources import markdown as M
from ..sources import nested
from .base import edges, entities, memory, query, table


@query("entity_extract")
def entity_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of all test items and of sentences with dates, products and names."""
    said = ["We met Ada Lovelace in Paris City on March 3rd, 2024 to port MyTool to Rust.", "Yesterday the data-lake job moved from Redis to PostgreSQL at Acme Labs.", "On 2024-05-06 nothing else."]
    own = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(said)], "id long, text string")
    all_ = own.unionByName(table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"))
    return X.extract(all_, "id", "text")


@query("entity_distinct")
def entity_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return X.distinct_entities(X.extract(memory(spark, sf), "mem_id", "chunk"))


_ASKED = [(1, "find recent errors in the API"), (2, "what changed yesterday"), (3, "running searches quickly"), (4, "ML model bug")]


#: Written down by the rules: acronyms (0.8), the synonyms of the first group whose phrase stands alone (0.7), times (0.6), endings (0.5).
_EXPANDED = """ SELECT * FROM (VALUES
  (1, 1, 'find recent errors in the Application Programming Interface', 'acronym', 0.8),
  (1, 2, 'look for recent errors in the API', 'synonym', 0.7),
  (1, 3, 'query recent errors in the API', 'synonym', 0.7),
  (1, 4, 'retrieve recent errors in the API', 'synonym', 0.7),
  (1, 5, 'search recent errors in the API', 'synonym', 0.7),
  (2, 1, 'what changed today', 'temporal', 0.6),
  (2, 2, 'what changed recent', 'temporal', 0.6),
  (2, 3, 'what changed last few days', 'temporal', 0.6),
  (2, 4, 'what changing yesterday', 'morphological', 0.5),
  (3, 1, 'runned searches quickly', 'morphological', 0.5),
  (3, 2, 'running searche quickly', 'morphological', 0.5),
  (3, 3, 'running searches quick', 'morphological', 0.5),
  (4, 1, 'Machine Learning model bug', 'acronym', 0.8),
  (4, 2, 'ML model defect', 'synonym', 0.7),
  (4, 3, 'ML model error', 'synonym', 0.7),
  (4, 4, 'ML model issue', 'synonym', 0.7),
  (4, 5, 'ML model problem', 'synonym', 0.7)) t(query_id, rank, text, kind, weight)"""


@query("query_expand", _EXPANDED)
def query_expand(spark: SparkSession, sf: str) -> DataFrame:
    return X.expand_queries(spark.createDataFrame(_ASKED, "query_id long, text string"))


_GRAPH = """ SELECT CAST(n_nationkey AS BIGINT) AS query_id, rank, CASE WHEN rank = 1 THEN 'search errors in ' || r_name ELSE word || ' errors in ' || n_name END AS text, CASE WHEN rank = 1 THEN 'knowledge_graph' ELSE 'synonym' END AS kind, CASE WHEN rank = 1 THEN 0.85 ELSE 0.7 END AS weight
 FROM nation JOIN region ON r_regionkey = n_regionkey, (VALUES (1, ''), (2, 'find'), (3, 'look for'), (4, 'query'), (5, 'retrieve')) w(rank, word)"""


@query("query_expand_graph", _GRAPH)
def query_expand_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Names of nations in queries, replaced by those of their regions, beside the other rewordings."""
    e = entities(spark, sf)
    named = G.relations(edges(spark, sf).where("relation = 'part_of'"), e).select("src_name", "tgt_name")
    asked = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat(F.lit("search errors in "), "n_name").alias("text"), "n_name")
    more = asked.join(named, asked["n_name"] == named["src_name"], "left").groupBy("query_id", "text").agg(F.array_sort(F.collect_list(F.concat(F.lit("search errors in "), "tgt_name"))).alias("extra"))
    return X.expand_queries(more)


_MD = """, d AS (SELECT doc_id, '# Doc ' || doc_id || chr(10) || text || chr(10) || '## Second' || chr(10) || 'tail' AS content FROM documents),
 l AS (SELECT doc_id, unnest(range(len(string_split(content, chr(10))))) AS n, unnest(string_split(content, chr(10))) AS line FROM d),
 m AS (SELECT *, length(regexp_extract(line, '^(#{1,6})(\\s|$)', 1)) AS level FROM l),
 s AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS nth FROM m)"""


@query(
    "markdown_sections",
    _MD + """ SELECT doc_id AS path, CAST(nth AS BIGINT) AS nth, trim(regexp_replace(arg_min(line, n), '^#+\\s*', '')) AS heading, min(n) AS line_start, max(n) AS line_end, arg_min(level, n) AS level,
   md5(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE level = 0), ''), '\\n+$', '')) AS digest FROM s GROUP BY doc_id, nth""",
)
def markdown_sections(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.concat(F.lit("# Doc "), F.col("doc_id").cast("string"), F.lit("\n"), "text", F.lit("\n## Second\ntail")).alias("content"))
    return M.sections(d).select("path", F.col("nth").cast("long").alias("nth"), "heading", "line_start", "line_end", "level", F.md5("content").alias("digest"))


@query("markdown_export", " SELECT session_id, md5(string_agg('## ' || source_channel || chr(10) || '<!-- id: ' || mem_id || ' -->' || chr(10) || chunk || chr(10), chr(10) ORDER BY mem_id)) AS digest FROM v_memory WHERE tombstone = 0 GROUP BY session_id", "v_memory")
def markdown_export(spark: SparkSession, sf: str) -> DataFrame:
    return M.export(memory(spark, sf).where("tombstone = 0")).select("session_id", F.md5("markdown").alias("digest"))


@query("path_get", " SELECT array_to_string(string_split((SELECT string_agg(chunk, chr(10) ORDER BY mem_id) FROM v_memory WHERE source_channel = 'src3' OR starts_with(source_channel, 'src3::')), chr(10))[3:6], chr(10)) AS text", "v_memory")
def path_get(spark: SparkSession, sf: str) -> DataFrame:
    return M.lines_of(memory(spark, sf), "src3", 2, 4)


@query("agents_report", " SELECT 'Memory: ' || count(*) || ' records, ' || count(*) FILTER (WHERE tombstone = 0) || ' active, ' || count(DISTINCT session_id) || ' sessions, channels: ' || (SELECT string_agg(source_channel || ' (' || n || ')', ', ' ORDER BY source_channel) FROM (SELECT source_channel, count(*) AS n FROM v_memory WHERE tombstone = 0 GROUP BY source_channel)) AS report FROM v_memory", "v_memory")
def agents_report(spark: SparkSession, sf: str) -> DataFrame:
    m = memory(spark, sf)
    by = m.where("tombstone = 0").groupBy("source_channel").agg(F.count("*").alias("n"))
    listed = by.agg(F.array_join(F.array_sort(F.collect_list(F.concat("source_channel", F.lit(" ("), F.col("n").cast("string"), F.lit(")")))), ", ").alias("channels"))
    head = m.agg(F.count("*").alias("n"), F.count_if(F.col("tombstone") == 0).alias("active"), F.count_distinct("session_id").alias("sessions"))
    return head.crossJoin(listed).select(F.format_string("Memory: %d records, %d active, %d sessions, channels: %s", "n", "active", "sessions", "channels").alias("report"))


@query("json_flatten", " SELECT event_id, 3 AS n, round(event_id + 1.5 + -2e1, 6) AS total FROM events")
def json_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of a nested JSON value, in order."""
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("[["), F.col("event_id").cast("string"), F.lit(", 1.5], [[-2e1]]]")).alias("j"))
    v = nested.flat_numbers(F.col("j"))
    return e.select("event_id", F.size(v).alias("n"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))
