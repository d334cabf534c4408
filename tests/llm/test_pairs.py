"""Near-dedup of vectors and fingerprints against all pairs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoria.llm import cover_tree, shared, simhash
from tests.llm import brute


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, v string, node long")


def clustered(seed=0, n=240, dim=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(20, dim))
    rows = []
    for i in range(n):
        x = base[i % 20] + rng.normal(0, 0.06 if i % 3 else 0.001, dim)
        rows.append((i, x.astype(np.float32).tolist(), int(i % 20 % 2), "x", 7))
    rows += [(n + k, rows[k][1], rows[k][2], "x", 7) for k in range(15)]  # copies
    rows += [(n + 20, [0.0] * dim, 0, "x", 7), (n + 21, None, 0, "x", 7), (n + 22, [float("nan")] * dim, 0, "x", 7), (n + 23, rows[0][1], None, "x", 7), (n + 24, [None] + rows[0][1][1:], 0, "x", 7), (n + 25, [], 0, "x", 7), (n + 26, rows[0][1][:5], 0, "x", 7)]
    return rows


def by_hand(rows, threshold=0.98):
    ok = {}
    for i, v, label, *_ in rows:
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = (np.array(v, np.float64), label)
    links = [(a, b) for a in ok for b in ok if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] / np.linalg.norm(ok[a][0]) / np.linalg.norm(ok[b][0]) >= threshold]
    n = {i: 0 for i, *_ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    c = brute.components(list(n), links)
    return {(i, n[i], c[i], c[i] == i) for i in n}


@pytest.mark.parametrize("leaf", [4096, 25])
def test_cover_tree_finds_all_links(spark, leaf):
    rows = clustered()
    got = {tuple(r) for r in cover_tree.near_duplicates(vectors(spark, rows), leaf=leaf).collect()}
    assert got == by_hand(rows)


def test_cover_tree_of_nothing(spark):
    assert cover_tree.near_duplicates(vectors(spark, [])).count() == 0


def test_dense_group_is_counted_without_pairs():
    rng = np.random.default_rng(3)
    x = np.ones(8) + rng.normal(0, 1e-4, (3000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = cover_tree.CoverTree(x, np.ones(3000, np.int64))
    w = cover_tree.Walk(t, t, 0.98)
    assert (w.na == 2999).all()
    assert len(w.edges) < 3 * 3000 and w.compared < 3000


def mixture(rng, clustered, clusters, scattered, dim=64):
    centres = rng.normal(size=(clusters, dim))
    x = np.concatenate([centres[np.arange(clustered) % clusters] + rng.normal(0, 0.05, (clustered, dim)), rng.normal(size=(scattered, dim))])
    return x[rng.permutation(len(x))] / 1.0


@pytest.mark.parametrize(("scattered", "share"), [(0, 0.05), (1600, 0.9)])
def test_trees_prune_what_has_clusters(scattered, share):
    """Of a mixture, what is scattered has to be compared with itself, and groups with their like."""
    x = mixture(np.random.default_rng(7), 2000 - scattered, 100, scattered)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = cover_tree.CoverTree(x, np.ones(2000, np.int64))
    w = cover_tree.Walk(t, t, 0.98)
    assert (w.na == (x @ x.T >= 0.98).sum(1) - 1).all() and w.na.sum() > 0
    assert len(t.centre) > 100 and w.compared < share * 2000 * 1999 / 2, w.compared
    a, b = cover_tree.CoverTree(x[:900], np.ones(900, np.int64)), cover_tree.CoverTree(x[900:], np.ones(1100, np.int64))
    v = cover_tree.Walk(a, b, 0.98)
    hit = x[:900] @ x[900:].T >= 0.98
    assert (v.na == hit.sum(1)).all() and (v.nb == hit.sum(0)).all() and v.compared < 1.2 * share * 900 * 1100, v.compared


def test_compared_pairs_are_reported(spark):
    x = mixture(np.random.default_rng(8), 3000, 60, 0, 16)
    df = spark.createDataFrame([(i, v.astype(np.float32).tolist(), i % 60 % 2, "x", 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int, v string, node long")
    for leaf in (4096, 300):
        r = cover_tree.pruning(df, leaf=leaf).first()
        assert r["points"] == 3000 and r["compared"] < 0.2 * r["pairs"], r


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables aren't here")
def test_the_drivers_vectors_have_no_clusters(spark):
    """No tree prunes much there, but none compares more than a product of matrices does."""
    r = cover_tree.pruning(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")).first()
    assert 0 < r["compared"] <= 1.5 * 2 * r["pairs"], r


def test_one_id_with_two_vectors_is_two_points(spark):
    e = lambda *x: [float(v) for v in x]
    rows = [(1, e(1, 0, 0), 0), (1, e(0, 1, 0), 0), (2, e(0, 1, 0.01), 0), (1, e(0, 1, 0), 1), (None, e(1, 0, 0.01), 0), (None, e(5, 0, 0), 3), (None, e(5, 0, 0), 3), ((1 << 60) + 1, e(0, 0, 1), 0)]
    got = cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1)).collect()
    key = lambda r: str(r)
    assert sorted(map(tuple, got), key=key) == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (1, 0, 1, True), (None, 1, 1, False), (None, 1, None, False), (None, 1, None, False), ((1 << 60) + 1, 0, (1 << 60) + 1, True)], key=key)


def test_levels_are_nested_and_cover():
    rng = np.random.default_rng(5)
    x = np.concatenate([b + rng.normal(0, 0.02, (40, 6)) for b in rng.normal(size=(6, 6))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = cover_tree.CoverTree(x, np.ones(len(x), np.int64))
    for k in range(len(t.centre)):
        d = np.linalg.norm(x[t.members[k]] - x[t.centre[k]], axis=1)
        assert d.max() <= t.radius[k] + 1e-6
        assert t.centre[k] in t.members[k] or t.bottom[k]
        if not t.bottom[k]:
            assert t.centre[t.kids[k][0]] == t.centre[k]
            assert sorted(np.concatenate([t.members[c] for c in t.kids[k]]).tolist()) == sorted(t.members[k].tolist())


def test_fingerprints_follow_the_rule():
    for t in [*brute.awkward()[:9], "A b\x0bC d", "É A", "a\x1cb c d e"]:
        assert simhash.fingerprint(t) == brute.simhash(t)


def test_bk_tree_finds_what_is_near():
    rng = np.random.default_rng(2)
    values = [int(v) for v in rng.integers(0, 2**63, 200)]
    values += [v ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for v in values[:100]]
    t = simhash.BKTree()
    for i, v in enumerate(values):
        t.add(v, i)
    for v in values[:60]:
        assert set(t.within(v, 2)) == {i for i, w in enumerate(values) if (v ^ w).bit_count() <= 2}


@pytest.mark.parametrize("shard", [1024, 7])
def test_near_pairs_join_all_within_two_bits(spark, shard):
    rng = np.random.default_rng(4)
    base = [int(v) for v in rng.integers(0, 2**63, 40)]
    values = set(base)
    for v in base[:6]:  # dense groups that share blocks
        for _ in range(30):
            v ^= 1 << int(rng.integers(64))
            values.add(v)
    values = sorted(values)
    links = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2]
    want = brute.components(range(len(values)), links)
    df = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)], "node long, fp long")
    found = {r["node"]: r["component"] for r in shared.components(simhash.near_pairs(df, shard=shard)).collect()}
    assert {i: found.get(i, i) for i in range(len(values))} == want


def test_simhash_query_on_awkward_texts(spark):
    texts = brute.awkward()
    got = simhash.near_duplicates(brute.docs(spark, texts)).collect()
    assert len(got) == len(texts)
    fp = {i: brute.simhash(t) for i, t in enumerate(texts)}
    want = brute.components(fp, [(i, j) for i in fp for j in fp if i > j and (fp[i] ^ fp[j]).bit_count() <= 2])
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    kept = simhash.keep_one_of_each(brute.docs(spark, texts))
    assert {r["doc_id"] for r in kept.collect()} == set(want.values())
    assert kept.columns == brute.docs(spark, []).columns
    assert simhash.near_duplicates(brute.docs(spark, [])).count() == 0


def test_rows_without_id_and_repeated_rows(spark):
    df = brute.docs(spark, [brute.PROSE[0]])
    both = df.unionByName(df).unionByName(df.withColumn("doc_id", F.lit(None).cast("long")))
    got = simhash.near_duplicates(both).collect()
    assert [r["component_id"] for r in got] == [0, 0, 0]
    assert [r["doc_id"] for r in simhash.keep_one_of_each(both).collect()] == [0]
    nameless = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert simhash.keep_one_of_each(nameless.unionByName(nameless)).count() == 1


def test_two_texts_under_one_id_are_both_judged(spark):
    rows = [(1, brute.PROSE[0]), (1, brute.PROSE[1]), (2, brute.PROSE[1]), (None, brute.PROSE[2]), (3, brute.PROSE[2])]
    left = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, left)) == sorted([(1, brute.PROSE[0]), (1, brute.PROSE[1]), (3, brute.PROSE[2])])


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(300, 301), (301, 302), (302, 300), (5, 5)]
    want = brute.components({x for e in links for x in e}, links)
    got = {r["node"]: r["component"] for r in shared.components(spark.createDataFrame(links, "u long, v long").repartition(4)).collect()}
    assert got == {n: c for n, c in want.items() if n != c}
    assert shared.components(spark.createDataFrame([], "u long, v long")).count() == 0
