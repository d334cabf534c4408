"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Equal vectors of a label are one point with a weight. Points of a label lie in cells around centres; a cell is cut into blocks of at most
``leaf`` points. A block is stored once, with its cover tree, as a file in the shared folder. What travels on are references: pairs of blocks
of which one holds a point that a point of the other's cell could be near to, by the distance to the bisecting plane of
the cells. A task opens two blocks and walks their trees together.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import Attempt, file_system
from .shared import components, fresh_path, give_back, materialize, over_groups, stream_groups, union_find

THRESHOLD = 0.98
#: Points of a block; centres of a label at most (a cell may have any number of blocks, so this bounds memory, not what is found).
LEAF, CENTRES = 4096, 4096
#: Partners of a block that one task walks it against.
PARTNERS = 16


class CoverTree:
    """Nested levels of centres with halving radii over unit vectors.

    Level i is a net: its centres are more than 2^-i apart and every point is within 2^-i of one. A centre is its own first
    child, so levels are nested. Points that are alone at a level stay together in one child, a bottom node around the same centre; those
    that have others near them are subtrees. ``radius`` is each node's covering radius, measured, not the level's bound.
    """

    def __init__(self, points: np.ndarray, weight: np.ndarray) -> None:
        self.points = points
        self.kids: list[np.ndarray] = []  # nodes, or points at the bottom
        self.members: list[np.ndarray] = []
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.bottom: list[bool] = []
        self.mass: list[int] = []
        self.weight = weight
        self.root = self._build(np.arange(len(points)), 0, 0) if len(points) else -1

    def _node(self, own: np.ndarray, centre: int) -> int:
        self.centre.append(centre)
        self.radius.append(float(_distances(self.points[centre : centre + 1], self.points[own]).max()))
        self.members.append(own)
        self.mass.append(int(self.weight[own].sum()))
        self.bottom.append(True)
        self.kids.append(own)
        return len(self.centre) - 1

    def _net(self, own: np.ndarray, centre: int, step: float) -> list[tuple[int, np.ndarray]]:
        """A greedy net of ``own``, the centre first: each point with the first net point that is within ``step`` of it."""
        left, out = np.concatenate([[centre], own[own != centre]]), []
        while len(left):
            some = left[:64]
            near = _distances(self.points[some], self.points[left]) <= step
            alive = np.ones(len(left), bool)
            for i, c in enumerate(some.tolist()):
                if alive[i]:
                    near[i, i] = True
                    out.append((c, left[near[i] & alive]))
                    alive &= ~near[i]
            left = left[alive]
        return out

    def _build(self, own: np.ndarray, centre: int, level: int) -> int:
        node = self._node(own, centre)
        if len(own) <= 16 or self.radius[node] <= 0.01:
            return node
        step = 2.0**-level
        while step >= self.radius[node]:  # levels at which this node would be alone
            level, step = level + 1, step / 2
        net = self._net(own, centre, step)
        groups = [(c, m) for c, m in net if len(m) > 1]
        if not groups:
            return node
        alone = np.concatenate([m for _, m in net if len(m) == 1] or [own[:0]])
        kids = [self._node(alone, centre)] if len(alone) else []
        kids += [self._build(m, c, level + 1) for c, m in groups]
        if groups[0][0] == centre and len(alone):
            kids[:2] = kids[1::-1]
        self.bottom[node] = False
        self.kids[node] = np.array(kids)
        return node


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


class Walk:
    """Dual traversal of ``a`` and ``b``: the same object walks a tree against itself, where each unordered pair is met once.

    ``na`` and ``nb`` count the links of their points by weight; ``edges`` (point of a, point of b) join all links; ``compared`` counts the
    distances and products that were computed.
    """

    def __init__(self, a: CoverTree, b: CoverTree, threshold: float) -> None:
        self.a, self.b, self.threshold = a, b, threshold
        self.reach = math.sqrt(2.0 - 2.0 * threshold) + 1e-6
        self.same = a is b
        self.na, self.nb = np.zeros(len(a.points), np.int64), np.zeros(len(b.points), np.int64)
        self.edges: list[tuple[int, int]] = []
        self.compared = 0
        todo = [(a.root, b.root)] if a.root >= 0 and b.root >= 0 else []
        while todo:
            todo += self._meet(*todo.pop())
        if self.same:
            self.na = self.nb = self.na + self.nb

    def _meet(self, x: int, y: int) -> list[tuple[int, int]]:
        """Count, list or prune what links members of node x of a and of node y of b; the pairs of nodes to look at next."""
        a, b = self.a, self.b
        if self.same and x == y:
            return self._alone(x)
        gap = float(self._far(a, [x], b, [y])[0, 0])
        rx, ry = a.radius[x], b.radius[y]
        if gap > rx + ry + self.reach:
            return []
        if gap + rx + ry < self.reach - 2e-6:  # all link: count, don't list
            p, q = a.members[x], b.members[y]
            self.na[p] += b.mass[y]
            self.nb[q] += a.mass[x]
            self._join([(int(i), int(q[0])) for i in p] + [(int(p[0]), int(j)) for j in q])
            return []
        if a.bottom[x] and b.bottom[y]:
            self._products(self._near(a, x, b, y), self._near(b, y, a, x), False)
            return []
        if b.bottom[y] or (not a.bottom[x] and rx >= ry):
            near = a.kids[x][self._far(a, a.kids[x], b, [y])[:, 0] <= np.array([a.radius[k] for k in a.kids[x]]) + ry + self.reach]
            return [(int(k), y) for k in near]
        near = b.kids[y][self._far(b, b.kids[y], a, [x])[:, 0] <= np.array([b.radius[k] for k in b.kids[y]]) + rx + self.reach]
        return [(x, int(k)) for k in near]

    def _alone(self, x: int) -> list[tuple[int, int]]:
        t, m = self.a, self.a.members[x]
        if 2 * t.radius[x] < self.reach - 2e-6:
            self.na[m] += t.mass[x] - t.weight[m]
            self._join([(int(m[0]), int(i)) for i in m[1:]])
            return []
        if t.bottom[x]:
            self._products(m, m, True)
            return []
        k = t.kids[x]
        r = np.array([t.radius[i] for i in k])
        i, j = np.nonzero(np.triu(self._far(t, k, t, k) <= r[:, None] + r + self.reach, 1))
        return [*((int(v), int(v)) for v in k), *zip(k[i].tolist(), k[j].tolist(), strict=True)]

    def _far(self, s: CoverTree, x: list, t: CoverTree, y: list) -> np.ndarray:
        self.compared += len(x) * len(y)
        return _distances(s.points[[s.centre[k] for k in x]], t.points[[t.centre[k] for k in y]])

    def _near(self, s: CoverTree, x: int, t: CoverTree, y: int) -> np.ndarray:
        """Members of node x of s that a member of node y of t could be near to."""
        m = s.members[x]
        if len(t.members[y]) == 1:
            return m
        self.compared += len(m)
        return m[_distances(s.points[m], t.points[t.centre[y]][None])[:, 0] <= t.radius[y] + self.reach]

    def _products(self, p: np.ndarray, q: np.ndarray, itself: bool, block: int = 256) -> None:
        a, b = self.a, self.b
        for i in range(0, len(p), block):
            for j in range(i if itself else 0, len(q), block):
                u, v = p[i : i + block], q[j : j + block]
                hit = a.points[u] @ b.points[v].T >= self.threshold
                self.compared += len(u) * len(v)
                if itself and i == j:
                    hit = np.triu(hit, 1)
                r, c = np.nonzero(hit)
                if len(r):
                    np.add.at(self.na, u[r], b.weight[v[c]])
                    np.add.at(self.nb, v[c], a.weight[u[r]])
                    self._join(list(zip(u[r].tolist(), v[c].tolist(), strict=True)))

    def _join(self, edges: list[tuple[int, int]]) -> None:
        self.edges += edges
        if len(self.edges) > 200_000:
            self.edges = _forest(self.edges, self.same)


def _forest(edges: list[tuple[int, int]], same: bool) -> list[tuple[int, int]]:
    """As many edges as join what the given ones join. Points of two trees are told apart by sign."""
    if same:
        return [(x, r) for x, r in union_find(edges).items() if x != r]
    kept, parent = [], {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in edges:
        r, s = find(i), find(-j - 1)
        if r != s:
            parent[r] = s
            kept.append((i, j))
    return kept


def _usable(v: Column) -> Column:
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _key(v: Column) -> list[Column]:
    """Two hashes that tell vectors apart: 128 bits."""
    return [F.xxhash64(v).alias("h"), F.xxhash64(F.lit("second"), v).alias("g")]


def _unit(v: object) -> np.ndarray:
    x = np.array(v, np.float64)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def points_of(vectors: DataFrame, leaf: int, centres: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """``(pid, label, dim, v, h, g, weight, least, cells, home)``: the distinct usable vectors of each label, each in its nearest cell; and the centres.

    Centres are at most ``centres`` vectors of each length, picked by a hash over all labels; a label of n rows uses the first n / leaf.
    """
    usable = vectors.where("ok")
    counts = usable.groupBy("label", F.size("v").alias("dim")).agg(F.least(F.ceil(F.count("*") / leaf), F.lit(centres)).cast("int").alias("cells"))
    most = {r["dim"]: r["most"] for r in counts.groupBy("dim").agg(F.max("cells").alias("most")).orderBy(F.desc("most"), "dim").limit(1000).collect()}
    tops: dict[int, np.ndarray] = {}
    for dim, k in most.items():
        if k > 1:
            got = usable.where(F.size("v") == dim).groupBy("v").agg(F.first(F.xxhash64("v")).alias("h")).orderBy("h", "v").limit(k).collect()
            tops[dim] = _unit([r["v"] for r in got])
    points = usable.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    points = points.withColumn("dim", F.size("v")).join(counts, ["label", "dim"]).select("label", "dim", "v", *_key(F.col("v")), "weight", "least", "cells")

    points = points.withColumn("pid", F.monotonically_increasing_id())
    out = T.StructType([*points.schema.fields, T.StructField("home", T.IntegerType())])
    names = points.schema.names

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.zeros(len(b), np.int32)
            dims, cells = (b.column(names.index(k)).to_numpy() for k in ("dim", "cells"))
            for dim in set(dims[cells > 1].tolist()) & set(tops):
                at = np.flatnonzero((dims == dim) & (cells > 1))
                v = b.column(names.index("v")).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
                d = _unit(v) @ tops[dim].T
                d[np.arange(d.shape[1]) >= cells[at, None]] = -2
                found[at] = d.argmax(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], names=out.names)
        give_back()

    return materialize(points.mapInArrow(home, out), "points"), tops


def find_links(points: DataFrame, tops: dict[int, np.ndarray], threshold: float = THRESHOLD, leaf: int = LEAF) -> DataFrame:
    """``(pid, links, to)``: weighted links of a point, or an edge; rows without pid count in ``links`` what was compared."""
    spark = points.sparkSession
    reach = math.sqrt(2 - 2 * threshold) + 1e-6
    schema = "pid long, links long, to long"

    def rows(walk: Walk, one: np.ndarray, two: np.ndarray) -> pd.DataFrame:
        counts = [(one, walk.na)] if walk.same else [(one, walk.na), (two, walk.nb)]
        edges = np.array(_forest(walk.edges, walk.same), np.int64).reshape(-1, 2)
        pid = np.concatenate([*(p[n > 0] for p, n in counts), one[edges[:, 0]]])
        links = np.concatenate([*(n[n > 0] for _, n in counts), np.zeros(len(edges), np.int64)])
        to = pd.array(np.concatenate([np.zeros(len(pid) - len(edges), np.int64), two[edges[:, 1]]]), "Int64")
        to[: len(pid) - len(edges)] = pd.NA
        return pd.concat([pd.DataFrame({"pid": pd.array(pid, "Int64"), "links": links, "to": to}), pd.DataFrame({"pid": pd.array([None], "Int64"), "links": [walk.compared], "to": pd.array([None], "Int64")})])

    def whole(_: tuple, g: pd.DataFrame) -> pd.DataFrame:
        t = CoverTree(_unit(g["v"].tolist()), g["weight"].to_numpy(np.int64))
        pid = g["pid"].to_numpy(np.int64)
        return rows(Walk(t, t, threshold), pid, pid)

    small = over_groups(points.where("cells = 1").select("label", "dim", "pid", "v", "weight"), ["label", "dim"], whole, schema, ["pid"])
    large = points.where("cells > 1")
    if not large.limit(1).count():
        return materialize(small, "links")

    # blocks: each written once, with its tree and the cells that it must meet
    folder = fresh_path(spark, "blocks")
    sizes = large.groupBy("label", "dim", "home").agg(F.ceil(F.count("*") / leaf).cast("int").alias("shards"))
    dealt = large.join(sizes, ["label", "dim", "home"]).withColumn("shard", F.pmod(F.xxhash64("pid"), F.col("shards")).cast("int"))
    keys = ["label", "dim", "home", "shard"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select(*keys, "cells", "pid", "v", "weight").repartition(n, *keys).sortWithinPartitions(*keys, "pid")

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        name = f"{task.partitionId()}-{task.taskAttemptId()}.blocks"
        out: list[tuple] = []
        with Attempt(folder, name) as file:
            at = 0
            for key, g in stream_groups(batches, keys):
                x = _unit(g["v"].tolist())
                top, mine = tops.get(int(key[1])), int(key[2])
                tree = CoverTree(x, g["weight"].to_numpy(np.int64))
                tree.points = None
                meets = np.array([mine])
                if top is not None:  # a length among very many has one cell
                    top = top[: int(g["cells"].iloc[0])]
                    d2 = 2 - 2 * (x @ top[mine:].T)
                    between = np.sqrt(np.maximum(2 - 2 * (top[mine:] @ top[mine]), 1e-12))
                    meets = mine + np.flatnonzero(((d2 - d2[:, :1]) / (2 * between) <= reach).any(0))
                body = pickle.dumps((g["pid"].to_numpy(np.int64), np.array(g["v"].tolist(), g["v"].iloc[0].dtype), tree), protocol=5)
                file.write(body)
                out.append((*key, name, at, len(body), sorted({mine, *meets.tolist()})))
                at += len(body)
        give_back()
        yield pd.DataFrame(out, columns=[*keys, "file", "at", "size", "meets"])

    head = large.select("label").schema.fields[0]
    listed = T.StructType([head, *T.StructType.fromDDL("dim int, home int, shard int, file string, at long, size long, meets array<int>").fields])
    blocks = materialize(dealt.mapInPandas(store, listed).withColumn("block", F.monotonically_increasing_id()), "blocks")
    place = F.struct("block", "file", "at", "size")
    asked = blocks.select("label", "dim", F.col("home").alias("own"), F.col("shard").alias("nth"), place.alias("a"), F.explode("meets").alias("home"))
    pairs = asked.join(blocks.select("label", "dim", "home", "shard", place.alias("b")), ["label", "dim", "home"]).where("own < home or nth <= shard").select("a", "b")
    bunch = F.pmod(F.xxhash64("b.block"), F.greatest(F.lit(1), F.lit(blocks.count() // PARTNERS)))
    pairs = pairs.select("a.*", F.col("b.block").alias("block2"), F.col("b.file").alias("file2"), F.col("b.at").alias("at2"), F.col("b.size").alias("size2"), bunch.alias("bunch"))
    pairs = pairs.repartition(n, "block", "bunch").sortWithinPartitions("block", "block2")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = file_system(folder)

        def opened(file: str, at: int, size: int) -> tuple[np.ndarray, CoverTree]:
            with system.open_input_file(f"{base}/{file}") as f:
                f.seek(at)
                pid, v, tree = pickle.loads(f.read(size))
            tree.points = _unit(v)
            return pid, tree

        held, own = None, None
        for b in batches:
            for r in b.itertuples(index=False):
                if r.block != held:
                    held, own = r.block, opened(r.file, r.at, r.size)
                other = own if r.block2 == held else opened(r.file2, r.at2, r.size2)
                yield rows(Walk(own[1], other[1], threshold), own[0], other[0])
        give_back()

    return materialize(pairs.mapInPandas(walk, schema).unionByName(small), "links")


def _rows(vectors: DataFrame) -> DataFrame:
    kind = vectors.schema["embedding"].dataType.elementType
    v = F.col("embedding") if isinstance(kind, T.FloatType) else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), v.alias("v"))
    return rows.withColumn("ok", F.coalesce(_usable(F.col("v")) & F.col("label").isNotNull(), F.lit(False)))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, leaf: int = LEAF, centres: int = CENTRES) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding, label)``.

    Vectors link if their labels are equal and not null and their cosine, in double precision, is at least ``threshold``.
    Null, empty or zero vectors and those with null or non-finite components link with nothing, nor do vectors of
    different lengths. Each row is a vector of its own: a repeated row links with its repetition, two vectors under one vec_id are
    two, and one without a vec_id links like others, names no component and isn't kept. Rows find their point by label and 128 bits of hash.
    """
    rows = _rows(vectors)
    points, tops = points_of(rows, leaf, centres)
    found = find_links(points, tops, threshold, leaf)
    joined = components(found.where("to is not null").select(F.col("pid").alias("u"), F.col("to").alias("v")))
    links = found.where("pid is not null").groupBy("pid").agg(F.sum("links").alias("links"))
    by = points.select("pid", "label", "h", "g", "weight", "least").join(links, "pid", "left").join(joined.withColumnRenamed("node", "pid"), "pid", "left")
    by = materialize(by.withColumn("component", F.coalesce("component", "pid")), "classes")
    named = by.groupBy("component").agg(F.min("least").alias("c"))
    by = by.join(named, "component").select("label", "h", "g", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "c", F.lit(True).alias("ok"))
    out = rows.select("vec_id", "label", "ok", *_key(F.col("v"))).join(by, ["label", "h", "g", "ok"], "left")
    own = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("c"))
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def pruning(vectors: DataFrame, threshold: float = THRESHOLD, leaf: int = LEAF, centres: int = CENTRES) -> DataFrame:
    """One row: ``points``, ``pairs`` that have equal labels, and how many distances were ``compared`` to find all links."""
    points, tops = points_of(_rows(vectors), leaf, centres)
    per = points.groupBy("label", "dim").agg(F.count("*").alias("n"))
    sums = per.agg(F.sum("n").alias("points"), F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"))
    compared = find_links(points, tops, threshold, leaf).where("pid is null").agg(F.coalesce(F.sum("links"), F.lit(0)).alias("n")).first()["n"]
    return sums.withColumn("compared", F.lit(compared).cast("long"))


def op1_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import table

    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
  SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x
)
SELECT e.vec_id, (SELECT count(*) FROM link WHERE x = e.vec_id) AS n_links,
  least(e.vec_id, coalesce((SELECT min(y) FROM reach WHERE x = e.vec_id), e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce((SELECT min(y) FROM reach WHERE x = e.vec_id), e.vec_id)) AS kept
FROM embeddings e
"""
