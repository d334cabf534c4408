"""Graph operators over ``edges(src, tgt, relation, weight)`` and ``entities(id, name, ...)``.

Walks are driver loops over joins; each step is cut from its lineage by a reliable checkpoint.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df``, evaluated and kept in the session's checkpoint folder; a local one is set only where it has none, as in tests."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="mnemoria-"))
    return df.checkpoint()


def both_ways(edges: DataFrame) -> DataFrame:
    """``(a, b, weight)``: each edge from either end; a self-loop once."""
    one = edges.select(F.col("src").alias("a"), F.col("tgt").alias("b"), "weight")
    return one.unionByName(edges.where("src <> tgt").select(F.col("tgt").alias("a"), F.col("src").alias("b"), "weight"))


def bfs(edges: DataFrame, entities: DataFrame, seed: int, depth: int) -> DataFrame:
    """``(id, depth)`` of entities within ``depth`` undirected steps, the seed excluded; ids without an entity are not walked through."""
    known = both_ways(edges).select("a", "b").join(entities.select(F.col("id").alias("b")), "b", "left_semi")
    spark = edges.sparkSession
    seen = spark.createDataFrame([(seed, 0)], "id long, depth int")
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(known, frontier["id"] == known["a"]).select(F.col("b").alias("id")).distinct()
        frontier = cut(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def subgraph(edges: DataFrame, entities: DataFrame, seeds: list[int], depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``depth`` of any seed, seeds included, and the edges with both ends among them."""
    spark = edges.sparkSession
    nodes = spark.createDataFrame([(s,) for s in seeds], "id long").join(entities.select("id"), "id", "left_semi")
    for s in seeds:
        nodes = nodes.unionByName(bfs(edges, entities, s, depth).select("id"))
    nodes = cut(nodes.distinct())
    inside = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("tgt")), "tgt", "left_semi")
    return nodes, inside


def spread(edges: DataFrame, seeds: dict[int, float], decay: float, least: float, steps: int) -> DataFrame:
    """``(id, activation)``: each step every node at or above ``least`` sends activation x weight x decay to its neighbours.

    A send below ``least`` has no effect. Nodes send their whole sum again each step; nothing is normalised.
    """
    spark = edges.sparkSession
    e = both_ways(edges)
    state = spark.createDataFrame(list(seeds.items()), "id long, activation double")
    for _ in range(steps):
        from_active = state.where(F.col("activation") >= least)
        sent = from_active.join(e, from_active["id"] == e["a"]).select(F.col("b").alias("id"), (F.col("activation") * F.col("weight") * decay).alias("activation"))
        state = cut(state.unionByName(sent.where(F.col("activation") >= least)).groupBy("id").agg(F.sum("activation").alias("activation")))
    return state


def resolve(names: DataFrame, entities: DataFrame, max_distance: int) -> DataFrame:
    """``(name, id, distance)``: for each name the entity with the least edit distance within the bound; ties go to the smallest id.

    An entity's name is cut into one piece more than edits are allowed. One of them stands unchanged in any name within the bound, at most
    so many places away, so candidates are joined by piece and length instead of all with all. Case doesn't count; null id and
    distance where nothing is near.
    """
    parts = max_distance + 1
    cut = lambda n, i: F.floor(n * i / parts).cast("int")
    asked = names.select("name").where("name is not null").distinct()
    each = F.explode(F.sequence(F.lit(0), F.lit(max_distance))).alias("part")
    own = entities.where("name is not null").select("id", F.lower("name").alias("own"), F.length("name").alias("len"), each)
    own = own.select("id", "own", "len", "part", F.expr(f"substring(own, cast(floor(len * part / {parts}) as int) + 1, cast(floor(len * (part + 1) / {parts}) as int) - cast(floor(len * part / {parts}) as int))").alias("piece"))
    n = F.length("name")
    wide = asked.select("name", F.lower("name").alias("low"), F.explode(F.sequence(F.greatest(n - max_distance, F.lit(0)), n + max_distance)).alias("len"))
    wide = wide.select("*", each).withColumns({"from": cut(F.col("len"), F.col("part")), "to": cut(F.col("len"), F.col("part") + 1)})
    wide = wide.withColumn("shift", F.explode(F.sequence(F.lit(-max_distance), F.lit(max_distance)))).where("`from` + shift >= 0 and `to` + shift <= length(low)")
    wide = wide.select("name", "low", "len", "part", F.expr("substring(low, `from` + shift + 1, `to` - `from`)").alias("piece")).distinct()
    near = wide.join(own, ["len", "part", "piece"]).select("name", "low", "id", "own").distinct()
    near = near.withColumn("distance", F.levenshtein("low", "own", max_distance)).where("distance >= 0")
    best = near.groupBy("name").agg(F.min(F.struct("distance", "id")).alias("b"))
    return asked.join(best, "name", "left").select("name", F.col("b.id").alias("id"), F.col("b.distance").alias("distance"))


def alias_replacement(query, aliases: list[tuple[str, str]]):  # noqa: ANN001, ANN201
    """The query in lower case, with each alias replaced by its entity's name, the longest alias (in bytes) first; later ones see earlier output."""
    out = F.lower(query)
    for alias, name in sorted(aliases, key=lambda a: (-len(a[0].encode()), a[0])):
        out = F.replace(out, F.lit(alias.lower()), F.lit(name))
    return out


def relations(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with both ends' names and a typed label."""
    a, b = entities.select(F.col("id").alias("src"), F.col("name").alias("src_name")), entities.select(F.col("id").alias("tgt"), F.col("name").alias("tgt_name"))
    label = F.when(F.col("relation").isin("part_of", "is_a", "contains"), "hierarchical").when(F.col("relation").isin("causes", "leads_to"), "causal").when(F.col("relation").isin("before", "after"), "temporal").when(F.col("relation") == "related_to", "associative").otherwise(F.concat(F.lit("custom:"), F.col("relation")))
    return edges.join(a, "src").join(b, "tgt").withColumn("label", label)


def context(edges: DataFrame, entities: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, context)``: a text block with the entity, its outgoing and its incoming edges, weights with three decimals."""
    named = relations(edges, entities)
    out = named.select(F.col("src").alias("id"), F.lit(0).alias("way"), F.col("tgt_name").alias("other"), "relation", "weight")
    into = named.select(F.col("tgt").alias("id"), F.lit(1).alias("way"), F.col("src_name").alias("other"), "relation", "weight")
    line = F.when(F.col("way") == 0, F.format_string("  -> %s [%s] %.3f", "other", "relation", "weight")).otherwise(F.format_string("  <- %s [%s] %.3f", "other", "relation", "weight"))
    wanted = out.unionByName(into).join(ids.select("id"), "id", "left_semi").select("id", "way", "other", line.alias("line"))
    lines = wanted.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("way", "other", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    head = entities.join(ids.select("id"), "id", "left_semi")
    return head.join(lines, "id", "left").select("id", F.concat_ws("\n", F.concat(F.lit("Entity: "), "name", F.lit(" ("), "entity_type", F.lit(")")), "lines").alias("context"))


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def resolve_or_create(found: DataFrame, entities: DataFrame, max_distance: int = 1) -> tuple[DataFrame, DataFrame]:
    """``(found with id and created, entities with what was created)`` for ``found(text, type, ...)`` in the order of its column ``seq``.

    A text is the existing entity with the least edit distance within the bound, whatever its type. Texts that are none are new entities, one
    for each text whatever its case, of the first one's type, with ids from the largest on. A batch is resolved against what was there before it:
    texts of one batch don't become each other.
    """
    from .store import numbered

    near = resolve(found.select(F.col("text").alias("name")), entities, max_distance).where("id is not null").select(F.col("name").alias("text"), "id")
    known = found.join(near, "text").withColumn("created", F.lit(False))
    fresh = found.join(near.select("text"), "text", "left_anti").withColumn("_low", F.lower("text"))
    first = fresh.groupBy("_low").agg(F.min("seq").alias("_first"), F.min_by("text", "seq").alias("name"), F.min_by("type", "seq").alias("entity_type"))
    most = entities.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("_next"))
    new = numbered(first, ["_first"], "_k").crossJoin(F.broadcast(most)).withColumn("id", F.col("_k") + F.col("_next"))
    made = fresh.join(new.select("_low", "id"), "_low").drop("_low").withColumn("created", F.lit(True))
    grown = entities.select("id", "name", "entity_type").unionByName(new.select("id", "name", "entity_type"))
    return known.unionByName(made), grown
