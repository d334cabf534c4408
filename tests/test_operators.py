"""Rules and edge cases on small inputs."""

import hashlib
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoria.functions import hashes, scores, text, vectors
from mnemoria.operators import ann, arrays, extract, graph, integrity, retrieval, store, strategy, temporal, tiers
from mnemoria.sources import markdown


def test_cosine_of_zero_is_zero(spark):
    r = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [1.0, 0.0])], "a array<double>, b array<double>").select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert [round(x["c"], 6) for x in r] == [0.0, 0.707107]


def test_gate_reasons(spark):
    said = ["", "OK!", "got it", "two words", "so it is really just ok", "it's a plan to ship the parser on friday"]
    r = [x[0] for x in spark.createDataFrame([(s,) for s in said], "t string").select(text.gate_reason(F.col("t"))).collect()]
    assert r == ["empty input", "trivial phrase: ok", "trivial phrase: got it", "too few words: 2 < 3", "high trivial ratio", None]


def test_correction_and_patterns(spark):
    rows = spark.createDataFrame([("piano x",), ("Actually, no",), ("fine",)], "t string")
    assert [r[0] for r in rows.select(text.is_correction(F.col("t"))).collect()] == [True, True, False]  # "piano x" holds "no "
    p = spark.createDataFrame([("please IGNORE previous",), ("system: act as",), ("nothing",)], "t string").select(text.suspicious_pattern(F.col("t")).alias("p"))
    got = p.select("p", text.pattern_severity(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("ignore previous", "Critical"), ("system:", "High"), (None, None)]


def test_min_max_of_equal_scores_is_zero(spark):
    one = spark.createDataFrame([(1, 3.0), (2, 3.0)], "id long, score double")
    assert {r["score"] for r in retrieval.min_max(one).collect()} == {0.0}


def test_fusion_keeps_what_one_list_lacks(spark):
    v = spark.createDataFrame([(1, 1.0), (2, 0.0)], "id long, score double")
    k = spark.createDataFrame([(2, 5.0), (3, 1.0)], "id long, score double")
    got = {r["id"]: round(r["score"], 6) for r in retrieval.fuse_weighted(v, k).collect()}
    assert got == {1: 0.7, 2: 0.3, 3: 0.0}


def test_bm25_counts_repeated_terms_and_skips_tombstones(spark):
    m = spark.createDataFrame([(1, "red fox", 0), (2, "red red dog", 0), (3, "red fox", 1), (4, "", 0)], "mem_id long, chunk string, tombstone int")
    once = {r["id"]: r["score"] for r in retrieval.bm25(m, "fox").collect()}
    twice = {r["id"]: r["score"] for r in retrieval.bm25(m, "fox fox").collect()}
    assert set(once) == {1}
    assert abs(twice[1] - 2 * once[1]) < 1e-12
    assert retrieval.bm25_stats(m, ["fox"]).first()["n_docs"] == 3


def test_reject_by_score_and_gap(spark):
    s = spark.createDataFrame([(1, 0.9), (2, 0.5), (3, 0.39), (4, 0.05)], "id long, score double")
    assert [r["id"] for r in retrieval.reject(s).collect()] == [1, 2]
    assert retrieval.reject(s.where("score < 0.06")).count() == 0


def test_rerank_future_is_now(spark):
    r = spark.createDataFrame([(2e9, "user_correction", 5.0)], "timestamp double, c string, a double").select(scores.rerank_score(F.col("timestamp"), F.col("c"), F.col("a"), 1e9)).first()[0]
    assert round(r, 6) == 1.0


def test_hnsw_recall_against_exact():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16))
    g = ann.HNSW(x)
    u = ann.unit(x)
    hit = 0
    for i in range(0, 600, 50):
        want = set(np.argsort(-(u @ u[i]))[:10].tolist())
        hit += len(want & {j for j, _ in g.search(x[i], 10)})
    assert hit / (12 * 10) >= 0.9


def test_kmeans_finds_separate_groups(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (np.eye(4)[i // 20] * 5 + rng.normal(0, 0.1, 4)).tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    own = ann.assign(df, ann.kmeans(df, 12)).collect()  # two seeds may fall into one group, none between two
    groups = {}
    for r in own:
        groups.setdefault(r["cluster"], set()).add(r["vec_id"] // 20)
    assert all(len(v) == 1 for v in groups.values()) and len(set().union(*groups.values())) == 4


def test_pq_trains_and_encodes(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 8))
    books = ann.pq_train(x, 2, 4)
    assert books.shape == (2, 4, 4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.pq_encode(df, books).orderBy("vec_id").collect()
    for r, v in zip(got, x, strict=True):
        assert r["codes"] == [int(((v[p * 4 : p * 4 + 4] - books[p]) ** 2).sum(1).argmin()) for p in range(2)]


def test_bfs_stops_at_unknown_ids(spark):
    e = spark.createDataFrame([(1, 2, "r", 1.0), (2, 3, "r", 1.0), (3, 4, "r", 1.0)], "src long, tgt long, relation string, weight double")
    n = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "id long, name string")
    assert {(r["id"], r["depth"]) for r in graph.bfs(e, n, 1, 3).collect()} == {(2, 1)}


def test_alias_longest_first(spark):
    q = spark.createDataFrame([("NYC and NY",)], "q string")
    assert q.select(graph.alias_replacement(F.col("q"), [("ny", "X"), ("nyc", "Y")])).first()[0] == "Y and X"


def test_chain_survives_a_cycle(spark):
    s = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "gone")], "session string, parent string")
    got = {(r["start"], r["session"], r["steps"]) for r in temporal.chains(s, s.select("session")).collect()}
    assert got == {("a", "a", 0), ("a", "b", 1), ("b", "b", 0), ("b", "a", 1), ("c", "c", 0)}


def test_as_of_takes_the_change_at_the_same_time(spark):
    t = spark.createDataFrame([(1, "k", 1.0, 1, 10.0), (1, "k", 2.0, 2, 20.0)], "entity_id long, property_key string, timestamp double, seq long, new_value double")
    a = spark.createDataFrame([(7, 1, "k", 2.0), (8, 1, "k", 0.5)], "ask_id long, entity_id long, property_key string, timestamp double")
    assert {r["ask_id"]: r["value"] for r in temporal.as_of(a, t).collect()} == {7: 20.0, 8: None}


def test_numbering_is_gapless_over_partitions(spark):
    got = store.numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")), ["x"], "n", partitions=5).collect()
    assert sorted((r["x"], r["n"]) for r in got) == [(i, i) for i in range(1000)]


def test_make_room_purges_before_it_evicts(spark):
    e = spark.createDataFrame([("a", 1, 5.0, 0.0), ("b", 0, 9.0, 0.0), ("c", 0, 1.0, 0.0), ("d", 9, 1.0, 50.0)], "key string, access_count int, last_accessed double, expires_at double")
    assert {r["key"] for r in tiers.make_room(e, 100.0, 4).collect()} == {"a", "b", "c"}
    assert {r["key"] for r in tiers.make_room(e.where("expires_at = 0"), 100.0, 3).collect()} == {"a", "b"}
    assert tiers.make_room(e.where("expires_at = 0"), 100.0, 9).count() == 3


def test_checksums():
    words = [0x6162, 0x6364, 0x6500]
    assert hashes.fletcher32_of(b"abcde") == (3 * words[0] + 2 * words[1] + words[2]) % 65535 << 16 | sum(words) % 65535
    assert hashes.lookup3_of(b"") == 0xDEADBEEF
    assert hashes.lookup3_of(b"Four score and seven years ago") == 0x17770551
    assert hashes.lookup3_of(b"Four score and seven years ago", 1) == 0xCD628161
    assert zlib.crc32(b"123456789") == 0xCBF43926


def test_fnv_of_known_strings(spark):
    rows = spark.createDataFrame([("",), ("a",), ("foobar",), ("é",), (None,)], "t string")
    got = [r[0] for r in rows.select(hashes.fnv1a64(F.col("t"))).collect()]
    fast = [r[0] for r in rows.select(hashes.fnv1a64_fast(F.col("t"))).collect()]
    assert got[:3] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8"]
    assert got == fast


def test_merkle_root_and_proofs(spark):
    texts = ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    levels = integrity.merkle_levels(df)
    h = lambda b: hashlib.sha256(b).digest()
    row = [h(b"\x00" + t.encode()) for t in texts] + [h(hashes.PAD_INPUT)] * 3
    while len(row) > 1:
        row = [h(b"\x01" + row[k] + row[k + 1]) for k in range(0, len(row), 2)]
    root = levels[-1].first()["h"]
    assert root == row[0].hex()
    for i, t in enumerate(texts):
        proof = integrity.merkle_proof(levels, i)
        assert integrity.verify_proof(t, i, proof, root)
        assert not integrity.verify_proof(t + "x", i, proof, root)


def test_cf_unpack_leaves_unpacked_values(spark):
    r = spark.createDataFrame([(5.0,), (-9999.0,)], "v double")
    none = F.lit(None).cast("double")
    assert [x[0] for x in r.select(arrays.cf_unpack(F.col("v"), none, none, F.lit(-9999.0), none)).collect()] == [5.0, -9999.0]
    got = [x[0] for x in r.select(arrays.cf_unpack(F.col("v"), F.lit(2.0), none, F.lit(-9999.0), none)).collect()]
    assert got[0] == 10.0 and got[1] != got[1]


def test_axis_names():
    assert arrays.axis_names([3, 4, 4], [("x", 4), ("y", 3)]) == ["y", "x", "dim_2"]


def test_entities_and_overlaps():
    got = extract.entities("We met Ada Lovelace in Paris City on March 3rd, 2024 to port MyTool to Rust, not a data-lake.")
    assert [(t, k) for t, k, *_ in got] == [("Ada Lovelace", "Person"), ("Paris City", "Location"), ("March 3rd, 2024", "Date"), ("MyTool", "Project"), ("Rust", "Technology"), ("data-lake", "Project")]
    t = "É 2024-05-06"
    assert extract.entities(t) == [("2024-05-06", "Date", 3, 13, 0.95)]


def test_expansions_are_distinct_and_ordered():
    got = extract.expand("find the API bug")
    assert len(got) == 5
    assert got[0][1] == "acronym"
    assert [w for *_, w in got] == sorted([w for *_, w in got], reverse=True)
    assert extract.expand("xyz") == []
    assert ("quick", "morphological", 0.5) in extract.expand("quickly")


def test_markdown_sections(spark):
    d = spark.createDataFrame([("p", "intro\n\n# One\ntext\n\n## Two\nmore"), ("q", "\n# Only"), ("r", None)], "path string, content string")
    got = [(r["path"], r["heading"], r["content"], r["line_start"], r["line_end"], r["level"]) for r in markdown.sections(d).orderBy("path", "nth").collect()]
    assert got == [("p", None, "intro", 0, 1, 0), ("p", "One", "text", 2, 4, 1), ("p", "Two", "more", 5, 6, 2), ("q", "Only", "", 1, 1, 1)]


def test_validation_tolerance(spark):
    s = spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, [1.0], "b"), (3, None, "c")], "id long, v array<double>, t string")
    t = spark.createDataFrame([(1, [1.00005, 2.0], "a"), (2, [1.1], "b"), (4, [1.0], "d")], "id long, v array<double>, t string")
    got = {r["id"]: r["problem"] for r in store.validate(s, t, "id", "v", ["t"]).collect()}
    assert got == {2: "v differs", 3: "missing in target", 4: "missing in source"}


def test_every_leaf_is_proven(spark, tmp_path):
    from mnemoria import registry
    from mnemoria.operators import integrity

    leaves = spark.createDataFrame([(i, f"item {i}") for i in range(11)], "item_id long, text string")
    leaves.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = registry.queries()["merkle_proof"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(i, 4, True, False) for i in range(11)]
    levels = integrity.merkle_levels(leaves.withColumnRenamed("item_id", "i"))
    root = levels[-1].first()["h"]
    for r in integrity.merkle_proofs(levels, leaves.withColumnRenamed("item_id", "i")).collect():
        assert integrity.verify_proof(r["text"], r["i"], [s["h"] for s in r["proof"]], root)


def test_hnsw_topk_answers_all_queries(spark, tmp_path):
    from mnemoria import registry
    from mnemoria.operators import retrieval

    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(1200, 64)))], "vec_id long, embedding array<double>")
    v.write.parquet(f"{tmp_path}/embeddings.parquet")
    v = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    pairs = lambda rows: {(r["query_id"], r["id"]) for r in rows.collect()}
    got = pairs(registry.queries()["hnsw_topk"](spark, str(tmp_path)))
    want = pairs(retrieval.batch_topk(v, v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 10))
    assert {q for q, _ in got} == set(range(0, 1200, 50)) and len(got) == 240
    assert len(got & want) >= 0.9 * len(want)


@pytest.mark.parametrize("name", ["ivf_probe", "rairs_probe", "pq_adc_rerank", "ivfpq_search", "hnsw_topk"])
@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the driver's tables aren't here")
def test_indexes_find_nine_of_ten(spark, name):
    from mnemoria import registry
    from mnemoria.operators import retrieval

    sf = "/root/testdata/sf0.1"
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    pairs = lambda rows: {(r["query_id"], r["id"]) for r in rows.collect()}
    want = pairs(retrieval.batch_topk(v, v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 10))
    got = pairs(registry.queries()[name](spark, sf))
    assert len(got & want) >= 0.9 * len(want), len(got & want) / len(want)


def test_a_probe_reads_the_folders_of_its_lists_alone(spark, tmp_path):
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(300, 8)))], "vec_id long, embedding array<double>")
    c = np.array(ann.kmeans(v, 6))
    ann.assign(v, c).repartition("cluster").write.partitionBy("cluster").parquet(f"{tmp_path}/lists")
    index = spark.read.parquet(f"{tmp_path}/lists")
    asked = v.where("vec_id = 7").withColumnRenamed("vec_id", "query_id")
    near = ann.nearest(np.array([asked.first()["embedding"]]), c, 2)[0].tolist()
    got = ann.search(index, asked, 300, c, 2)
    assert {r["id"] for r in got.collect()} == {r["vec_id"] for r in index.where(F.col("cluster").isin(near)).collect()}
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "cluster" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_chains_have_no_longest_length(spark):
    s = spark.range(5000).select(F.col("id").cast("string").alias("session"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent"))
    got = temporal.chains(s, s.where("session = '4999'").select("session"))
    assert got.agg(F.max("steps")).first()[0] == 4999 and got.count() == 5000


def test_a_correction_with_nulls_is_saved_once(spark):
    rows = [(1, None, "no, that is wrong, use the other one", "done"), (2, "x", None, "well"), (3, None, "please show me the whole list again", "here")]
    x = spark.createDataFrame(rows, "conv_id long, note string, user_turn string, agent_turn string")
    got = sorted((r["conv_id"], r["source_channel"]) for r in strategy.on_correction(x).collect())
    assert got == [(1, "correction"), (3, "exchange")]


def test_rates_are_over_all_writes(spark):
    rng = np.random.default_rng(3)
    t = np.sort(np.round(rng.uniform(0, 600, 200), 3))
    e = spark.createDataFrame([(i, float(x), "User" if i % 3 else "Tool") for i, x in enumerate(t)], "event_id long, timestamp double, source string")
    got = {r["event_id"]: r["in_window"] for r in strategy.rate_alerts(e, most=5).collect()}
    at = np.round(t * 1e6).astype(np.int64)
    assert got == {i: int(((at <= at[i]) & (at >= at[i] - 60_000_000)).sum()) for i in range(200)}


def test_filters_round_trip():
    from mnemoria.functions import codecs

    rng = np.random.default_rng(4)
    for n in (0, 1, 7, 1000):
        whole = rng.integers(-(2**40), 2**40, n)
        assert (codecs.offset_unpack(codecs.offset_pack(whole), n) == whole).all()
        prices = np.round(rng.uniform(-1e5, 1e5, n), 2)
        assert np.abs(codecs.decode_chunk(codecs.encode_chunk(prices, 2), n, 2) - prices).max(initial=0) < 1e-6
        small = rng.integers(0, 2**11, n)
        assert (codecs.n_bit_unpack(codecs.n_bit_pack(small << 3, 11, 3), n, 11, 3) == small << 3).all()
    raw = rng.bytes(1003)
    assert codecs.unshuffle(codecs.shuffle(raw, 8), 8) == raw and codecs.shuffle(b"abcdef", 2) == b"acebdf"
    with pytest.raises(ValueError):
        codecs.opened(codecs.sealed(b"abc")[:-1] + b"x")


def test_half_precision_and_keyed_hashes(spark):
    import hashlib
    import hmac

    from mnemoria.functions import codecs

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 10.0 ** rng.integers(-9, 6, 500)), [0.0, 1.0, -2.0, 65504.0, 65519.9, 65520.0, 6e-8, 2.0**-14, 2.0**-24, 1e-9, 0.1, 1 / 3]])
    got = [r[0] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(codecs.half(F.col("x"))).collect()]
    with np.errstate(over="ignore"):
        want = x.astype(np.float16).astype(np.float64)
    assert got == want.tolist()
    assert (codecs.from_half_bits(np.arange(0x7C00)) == np.arange(0x7C00, dtype=np.uint16).view(np.float16).astype(np.float32)).all()
    for key in (b"", b"k" * 64, b"k" * 100):
        r = spark.createDataFrame([(b"some bytes",)], "d binary").select(codecs.hmac_sha256(F.col("d"), key)).first()[0]
        assert r == hmac.new(key, b"some bytes", hashlib.sha256).hexdigest()


def test_a_flush_keeps_the_current_version_until_it_is_whole(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    store.flush(spark.range(3), folder)
    first = store.current(spark, folder)
    with pytest.raises(Exception, match="(?i)raise|error|fail"):
        store.flush(spark.range(5).select(F.raise_error(F.lit("lost")).alias("id")), folder)
    assert store.current(spark, folder).count() == 3
    store.flush(spark.range(5), folder)
    assert store.current(spark, folder).count() == 5 and first.count() == 3
    assert store.snapshot(spark, folder, f"{folder}/copy").count() == 5


def test_lookup3_of_known_strings():
    from mnemoria.functions.hashes import lookup3_of

    assert [lookup3_of(b""), lookup3_of(b"", 0xDEADBEEF), lookup3_of(b"Four score and seven years ago"), lookup3_of(b"Four score and seven years ago", 1)] == [0xDEADBEEF, 0xBD5B7DDE, 0x17770551, 0xCD628161]


def test_names_resolve_as_by_hand(spark):
    rng = np.random.default_rng(6)
    names = ["".join(rng.choice(list("abc"), rng.integers(0, 7))) for _ in range(60)]
    e = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    asked = sorted({n.upper()[:-1] + "c" for n in names} | {"zzzzzzz"})

    def edits(a, b):
        prev = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            cur = [i]
            for j, d in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != d)))
            prev = cur
        return prev[-1]

    for most in (1, 2):
        got = {r["name"]: (r["distance"], r["id"]) for r in graph.resolve(spark.createDataFrame([(a,) for a in asked], "name string"), e, most).collect()}
        best = {a: min((edits(a.lower(), n), i) for i, n in enumerate(names)) for a in asked}
        assert got == {a: b if b[0] <= most else (None, None) for a, b in best.items()}


def test_numbers_hold_where_rows_are_read_twice(spark):
    rows = spark.range(60_000).select(((F.col("id") * 7919) % 60_000).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    done = store.numbered(rows, ["k"], "n")
    assert done.where("n <> k").count() == 0
    assert done.where("n <> k or text is null").count() == 0
    assert done.agg(F.sum(F.when(F.col("n") != F.col("k"), F.length("text"))).alias("s")).first()["s"] is None


def test_numbers_of_nulls_and_of_no_rows(spark):
    rows = spark.createDataFrame([(None, "b"), (3.5, "a"), (float("nan"), "c"), (None, "a"), (-1.0, None)], "x double, y string")
    assert [r["y"] for r in store.numbered(rows, ["x", "y"], "n").orderBy("n").collect()] == ["a", "b", None, "a", "c"]
    assert store.numbered(rows.where("false"), ["x"], "n").count() == 0


def test_compaction_of_many_rows_keeps_their_order(spark):
    k = (F.col("id") * 7919) % 60_000
    m = spark.range(60_000).select(k.alias("mem_id"), F.sha2(F.col("id").cast("string"), 256).alias("chunk"), F.when(k % 10 == 0, 1).otherwise(0).alias("tombstone"), F.lit(1.0).alias("activation"))
    done = store.run_compaction(m)
    want = F.col("old_id") - F.floor(F.col("old_id") / 10) - 1
    assert done.agg(F.count("*"), F.count_if(F.col("mem_id") != want), F.max(F.length("chunk"))).first() == (54_000, 0, 64)


def _past(t, users, micros):
    at = np.round(t * 1e6).astype(np.int64)
    return [(int(m.sum()), users[m].mean()) for m in ((at <= a) & (at >= a - micros) for a in at)]


def test_rates_add_each_event_once(spark):
    rng = np.random.default_rng(6)
    t = np.concatenate([rng.integers(0, 600, 300).astype(float), [60.0, 120.0, 120.000001, 179.999999, 180.0]])  # many at once, and at the ends of windows
    e = spark.createDataFrame([(i, float(x), "User") for i, x in enumerate(t)] + [(1000, None, "User"), (1001, None, "Tool")], "event_id long, timestamp double, source string")
    done = strategy.rate_alerts(e, most=5)
    got = {r["event_id"]: r["in_window"] for r in done.collect()}
    assert got == {i: n for i, (n, _) in enumerate(_past(t, np.ones(len(t)), 60_000_000))} | {1000: 2, 1001: 2}
    assert "RangeFrame, -" not in done._jdf.queryExecution().executedPlan().toString()  # a frame that slides is added up anew for each row


def test_shares_add_each_event_once(spark):
    rng = np.random.default_rng(7)
    t, user = rng.integers(0, 600, 300).astype(float), rng.random(300) < 0.7
    e = spark.createDataFrame([(i, float(x), "User" if u else None) for i, (x, u) in enumerate(zip(t, user, strict=True))], "event_id long, timestamp double, source string")
    done = strategy.source_alerts(e)
    got = {r["event_id"]: (r["in_window"], r["user_share"]) for r in done.collect()}
    assert got == dict(enumerate(_past(t, user, 60_000_000)))
    assert done.columns == [*e.columns, "in_window", "user_share", "severity"]
    assert "RangeFrame, -" not in done._jdf.queryExecution().executedPlan().toString()


def _peak_mb(spark, monkeypatch, make, columns):
    """The memory that a task's function takes for two Arrow batches of 10,000 rows of 64 numbers."""
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql.classic.dataframe import DataFrame

    runs, real = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, run, schema: runs.append(run) or real(self, run, schema))
    make()
    monkeypatch.setattr(DataFrame, "mapInArrow", real)
    rng = np.random.default_rng(8)
    batches = []
    for n in range(2):
        v = pa.array(list(rng.normal(size=(10_000, 64))), pa.list_(pa.float64()))
        every = {"vec_id": pa.array(np.arange(10_000) + n * 10_000), "embedding": v, "cluster": pa.array(np.arange(10_000, dtype=np.int32) % 4), "codes": pa.array([[1, 2]] * 10_000, pa.list_(pa.int32()))}
        batches.append(pa.RecordBatch.from_arrays([every[c] for c in columns], names=columns))
    tracemalloc.start()
    rows = sum(len(b) for b in runs[-1](iter(batches)))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert rows
    return peak


def _vectors(spark, n):
    return spark.range(n).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda j: F.sin(F.col("id") * j)).alias("embedding"))


@pytest.mark.parametrize("kind", ["lists", "copies", "codes", "both"])
def test_index_search_holds_small_matrices(spark, monkeypatch, kind):
    v, rng = _vectors(spark, 2000), np.random.default_rng(9)
    index = v.withColumns({"cluster": F.lit(0), "codes": F.array(F.lit(0), F.lit(1))})
    c = rng.normal(size=(4, 64)) if kind != "codes" else None
    books = rng.normal(size=(2, 4, 32)) if kind in ("codes", "both") else None
    columns = ["vec_id", "embedding", *(["cluster"] if c is not None else []), *(["codes"] if books is not None else [])]
    ask = lambda: ann.search(index, v.withColumnRenamed("vec_id", "query_id"), 10, c, 4 if c is not None else 0, books, 60 if books is not None else 0, 2 if kind == "copies" else 1)
    assert _peak_mb(spark, monkeypatch, ask, columns) < 100


def test_code_words_are_fitted_to_all_rows(spark, tmp_path):
    from mnemoria import registry

    wave = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda j: F.sin(F.col("vec_id") * j * 0.37 + j).cast("float"))
    spark.range(20_500).select(F.col("id").alias("vec_id")).select("vec_id", wave.alias("embedding"), F.lit(1).alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    v = spark.read.parquet(f"{tmp_path}/embeddings.parquet").orderBy(F.md5(F.col("vec_id").cast("string"))).toPandas()
    x = np.array(v["embedding"].tolist(), np.float64)
    want = dict(zip(v["vec_id"], ann.pq_codes(x, ann.pq_train(x, 32, 16, 5)).tolist(), strict=True))
    got = {r["vec_id"]: r["codes"] for r in registry.queries()["pq_encode"](spark, str(tmp_path)).collect()}
    assert got == {i: "-".join(map(str, c)) for i, c in want.items()}


def test_lists_are_chosen_for_few_rows_at_once(spark, monkeypatch):
    c = np.random.default_rng(10).normal(size=(32, 64)).tolist()
    assert _peak_mb(spark, monkeypatch, lambda: ann.rairs_assign(_vectors(spark, 10), c), ["vec_id", "embedding"]) < 150


def test_exact_search_holds_small_matrices(spark, monkeypatch):
    v = _vectors(spark, 2000)
    assert _peak_mb(spark, monkeypatch, lambda: retrieval.batch_topk(v, v.withColumnRenamed("vec_id", "query_id"), 5), ["vec_id", "embedding"]) < 100


def test_equal_vectors_are_ranked_by_id(spark):
    row = np.random.default_rng(11).normal(size=64)
    v = spark.createDataFrame([(i, row.tolist()) for i in range(1500)], "vec_id long, embedding array<double>").orderBy(F.desc("vec_id"))
    asked = v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    got = retrieval.batch_topk(v, asked, 5).collect()
    assert {(r["query_id"], r["id"], r["rank"]) for r in got} == {(q, i, i + 1) for q in range(0, 1500, 50) for i in range(5)}


def test_new_rows_and_labels_meet_the_store_in_small_matrices(spark, monkeypatch):
    v = _vectors(spark, 2000).withColumnRenamed("vec_id", "id")
    assert _peak_mb(spark, monkeypatch, lambda: strategy.semantic_shift(v, v), ["vec_id", "embedding"]) < 100


def test_surprise_holds_small_matrices(spark, monkeypatch):
    v = _vectors(spark, 4000).withColumnRenamed("vec_id", "id")
    assert _peak_mb(spark, monkeypatch, lambda: tiers.surprise(v, v), ["vec_id", "embedding"]) < 100


def test_surprise_is_of_earlier_rows_in_any_block(spark):
    rng = np.random.default_rng(12)
    x, order = rng.normal(size=(90, 4)), rng.permutation(90)
    v = spark.createDataFrame([(int(i), x[i].tolist()) for i in order], "id long, embedding array<double>")
    got = {r["id"]: r["surprise"] for r in tiers.surprise(v, v.where("id % 3 = 0"), block=7).collect()}
    u = ann.unit(x)
    want = {i: 1 - max((u[j] @ u[i] for j in range(0, i, 3)), default=0.0) for i in range(90)}
    assert got.keys() == want.keys() and all(abs(got[i] - min(max(w, 0.0), 1.0)) < 1e-9 for i, w in want.items())


def test_texts_are_cut_each_by_itself(spark):
    m = spark.createDataFrame([(1, "b a, B c b"), (2, ""), (3, None), (4, "gone")], "mem_id long, chunk string").withColumn("tombstone", (F.col("mem_id") == 4).cast("int"))
    done = retrieval.cuts(m)
    assert {r["id"]: (r["dl"], dict(zip(r["terms"], r["tfs"], strict=True))) for r in done.collect()} == {1: (5, {"a": 1, "b": 3, "c": 1}), 2: (0, {}), 3: (None, {})}
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()


def test_an_index_of_texts_has_a_row_for_each_vector_of_an_id(spark, tmp_path):
    from mnemoria.plans import base

    for name, ids in (("one", [1, 2]), ("two", [1, 1])):
        spark.createDataFrame([(1, "red fox", "en", "web", 7), (2, "red", "en", "web", 3)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(i, [1.0], 0) for i in ids], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        index, texts = base.search_index(spark, f"{tmp_path}/{name}"), base._texts(spark, f"{tmp_path}/{name}")
        assert index.n_docs == len({1, 2}) + (name == "two") and index.frequencies(["fox"]) == {"fox": 1 + (name == "two")}
        assert ("Join" in texts.drop("embedding")._jdf.queryExecution().optimizedPlan().toString()) == (name == "two")


def test_a_batch_of_queries_is_scored_where_documents_lie(spark, tmp_path):
    from mnemoria.operators.index import SearchIndex

    rng = np.random.default_rng(13)
    words = np.array(["red", "fox", "dog", "sun", "sea", "oak", "ice"])
    texts = ["red fox and red dog"] * 60 + [" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(140)]
    m = spark.createDataFrame([(i, t, 0, None) for i, t in enumerate(texts)], "mem_id long, chunk string, tombstone int, embedding array<double>").repartition(3)
    index = SearchIndex.build(m, f"{tmp_path}/index", keep=())
    asked = {7: "red fox", 8: "sun sea sun", 9: "nothing here", 10: "ice", 11: "and"}
    batch = index.bm25_batch(spark.createDataFrame(list(asked.items()), "query_id long, text string"), 5, 9)
    got = {q: [(r["id"], r["rank"], round(r["score"], 9)) for r in sorted(batch.collect(), key=lambda r: r["rank"]) if r["query_id"] == q] for q in asked}
    for q, t in asked.items():
        scored = sorted(((-round(r["score"], 9), r["id"]) for r in retrieval.bm25(m, t).collect()))[:5]
        assert got[q] == [(i, n + 1, -s) for n, (s, i) in enumerate(scored)]
    assert [i for i, _, _ in got[11]] == [0, 1, 2, 3, 4]
    plan = batch._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(query_id" in plan


def test_surprise_is_dealt_to_all_cores(spark):
    v = _vectors(spark, 200).withColumnRenamed("vec_id", "id")
    s = tiers.surprise(v.coalesce(1), v.where("id < 50"))
    scans = s.select("id")._jdf.queryExecution().analyzed().collectLeaves()
    parts = [scans.apply(i).rdd().getNumPartitions() for i in range(scans.size()) if "LogicalRDD" in scans.apply(i).getClass().getName()]
    assert parts and min(parts) >= 12
