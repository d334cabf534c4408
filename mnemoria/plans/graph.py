"""Graph queries over regions, nations, suppliers and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from .base import edges, entities, query

_BOTH = ", und AS (SELECT src AS a, tgt AS b, weight FROM v_edge UNION ALL SELECT tgt, src, weight FROM v_edge WHERE src <> tgt)"
_WALK = ", walk(id, depth) AS (SELECT {seed}::BIGINT, 0 UNION SELECT u.b, w.depth + 1 FROM walk w JOIN und u ON u.a = w.id JOIN v_entity e ON e.id = u.b WHERE w.depth < {depth})"


@query("graph_bfs", _BOTH + _WALK.format(seed=1003, depth=3) + " SELECT id, min(depth) AS depth FROM walk WHERE id <> 1003 GROUP BY id", "v_entity v_edge")
def graph_bfs(spark: SparkSession, sf: str) -> DataFrame:
    return G.bfs(edges(spark, sf), entities(spark, sf), 1003, 3)


@query("graph_subgraph", _BOTH + _WALK.format(seed=1003, depth=2) + ", nodes AS (SELECT DISTINCT id FROM walk) SELECT src, tgt, relation, weight FROM v_edge WHERE src IN (FROM nodes) AND tgt IN (FROM nodes)", "v_entity v_edge")
def graph_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    return G.subgraph(edges(spark, sf), entities(spark, sf), [1003], 2)[1]


def _spread_sql(steps: int) -> str:
    out = _BOTH + ", s0 AS (SELECT 1003::BIGINT AS id, 1.0::DOUBLE AS x UNION ALL SELECT 1007, 0.5)"
    for k in range(steps):
        out += f", s{k + 1} AS (SELECT id, sum(x) AS x FROM (SELECT id, x FROM s{k} UNION ALL SELECT b, x * weight * 0.5::DOUBLE FROM s{k} JOIN und ON a = id WHERE x >= 0.05::DOUBLE AND x * weight * 0.5::DOUBLE >= 0.05::DOUBLE) GROUP BY id)"
    return out + f" SELECT id, round(x, 6) AS activation FROM s{steps}"


@query("graph_activation", _spread_sql(3), "v_entity v_edge")
def graph_activation(spark: SparkSession, sf: str) -> DataFrame:
    return G.spread(edges(spark, sf), {1003: 1.0, 1007: 0.5}, 0.5, 0.05, 3).select("id", F.round("activation", 6).alias("activation"))


@query(
    "entity_resolve",
    """, asked AS (SELECT DISTINCT substr(name, 1, length(name) - 1) || 'x' AS name FROM v_entity WHERE entity_type IN ('nation', 'region')),
 near AS (SELECT a.name, e.id, levenshtein(lower(a.name), lower(e.name)) AS distance FROM asked a JOIN v_entity e ON abs(length(a.name) - length(e.name)) <= 2)
 SELECT a.name, n.id, n.distance FROM asked a LEFT JOIN (SELECT * FROM near WHERE distance <= 2 QUALIFY row_number() OVER (PARTITION BY name ORDER BY distance, id) = 1) n ON a.name = n.name""",
    "v_entity",
)
def entity_resolve(spark: SparkSession, sf: str) -> DataFrame:
    e = entities(spark, sf)
    asked = e.where(F.col("entity_type").isin("nation", "region")).select(F.expr("concat(substring(name, 1, length(name) - 1), 'x')").alias("name"))
    return G.resolve(asked, e, 2)


_ALIASES = [("the us", "UNITED STATES"), ("us", "UNITED STATES"), ("uk", "UNITED KINGDOM"), ("deutschland", "GERMANY")]


@query("alias_resolve", ", a AS (SELECT e.id, 'The US and ' || e.name || ' via Deutschland' AS q FROM v_entity e WHERE entity_type = 'nation') SELECT id, replace(replace(replace(replace(lower(q), 'deutschland', 'GERMANY'), 'the us', 'UNITED STATES'), 'uk', 'UNITED KINGDOM'), 'us', 'UNITED STATES') AS resolved FROM a", "v_entity")
def alias_resolve(spark: SparkSession, sf: str) -> DataFrame:
    q = F.concat(F.lit("The US and "), "name", F.lit(" via Deutschland"))
    return entities(spark, sf).where("entity_type = 'nation'").select("id", G.alias_replacement(q, _ALIASES).alias("resolved"))


@query(
    "entity_context",
    """, l AS (SELECT e.src AS id, 0 AS way, t.name AS other, format('  -> {} [{}] {:.3f}', t.name, e.relation, e.weight) AS line FROM v_edge e JOIN v_entity t ON t.id = e.tgt
   UNION ALL SELECT e.tgt, 1, s.name, format('  <- {} [{}] {:.3f}', s.name, e.relation, e.weight) FROM v_edge e JOIN v_entity s ON s.id = e.src)
 SELECT n.id, 'Entity: ' || n.name || ' (' || n.entity_type || ')' || coalesce(chr(10) || string_agg(line, chr(10) ORDER BY way, other), '') AS context
 FROM v_entity n LEFT JOIN l ON l.id = n.id WHERE n.entity_type = 'nation' GROUP BY n.id, n.name, n.entity_type""",
    "v_entity v_edge",
)
def entity_context(spark: SparkSession, sf: str) -> DataFrame:
    e = entities(spark, sf)
    return G.context(edges(spark, sf), e, e.where("entity_type = 'nation'"))


@query(
    "entity_relations",
    " SELECT e.src, e.tgt, s.name AS src_name, t.name AS tgt_name, CASE WHEN relation IN ('part_of', 'is_a', 'contains') THEN 'hierarchical' ELSE 'custom:' || relation END AS label FROM v_edge e JOIN v_entity s ON s.id = e.src JOIN v_entity t ON t.id = e.tgt",
    "v_entity v_edge",
)
def entity_relations(spark: SparkSession, sf: str) -> DataFrame:
    return G.relations(edges(spark, sf), entities(spark, sf)).select("src", "tgt", "src_name", "tgt_name", "label")
