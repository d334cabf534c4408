"""Token files, packing, language ID, quality and the pipeline."""

import io
import os
import random
import zlib
from itertools import combinations_with_replacement

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mnemoria.llm import language, packing, quality, token_files, tokens
from mnemoria.llm.tokens import Ids
from tests.llm import brute

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
ODD = [" ", "  ", "\n", "\t", "a", "B", "é", "ñ", "1", "½", "_", ".", ",", "'", "'s", "'LL", " ", " ", "—", "ß", "ﬁ", "́", "Σ", "İ", "中", "😀", "\x1c", "\x85", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "word", "Ünï"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name):
    own, library = Ids(P.path(name)), Tokenizer.from_file(str(P.path(name)))
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choices(ODD, k=rng.randint(0, 12)))
        assert np.frombuffer(own.of(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    assert own.of(None) == own.of("") == b""


def _asked_of_the_model(name):
    """How often the library's model is asked for the merges of a pretoken in 5,000 words, no two alike, and one of 60 bytes; their ids are checked."""
    own, library, asked = Ids(P.path(name)), Tokenizer.from_file(str(P.path(name))), []
    merge, own.merge = own.merge, lambda p: asked.append(p) or merge(p)
    rng = random.Random(2)
    words = {"".join(rng.choices("abcdehinorstéñß", k=rng.randint(4, 20))) + rng.choice(["", "", ".", ",", ".\nA", "!!", "'s", "12"]) for _ in range(5000)}
    for t in [" ".join(sorted(words)), "ab" * 30]:
        assert np.frombuffer(own.of(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    return len(asked)


def test_op6_merges_new_words_together():
    assert _asked_of_the_model("byte_bpe_50k.json") == 1


def test_op8_merges_new_words_together():
    assert _asked_of_the_model("word_bpe_49k.json") == 1


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_across_blocks(name, monkeypatch):
    for what, n in (("BLOCK", 7), ("REMEMBERED", 3000), ("WORDS", 3), ("LONG", 9)):
        monkeypatch.setattr(tokens, what, n)
    own, library = Ids(P.path(name)), Tokenizer.from_file(str(P.path(name)))
    rng = random.Random(3)
    some = [*ODD[2:8], " ", " ", " ", ".", "'s", "Word", "unforeseeable", " the", "\n\n", "12", "İ", "  "]
    texts = ["".join(rng.choices(some[: rng.choice([-2, None])], k=rng.randint(0, 40))) for _ in range(1000)]
    got = own.all([None, *texts])
    assert got[0] == b"" and len(got) == 1001
    for t, ids in zip(texts, got[1:], strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_files_round_trip(spark, tmp_path):
    texts = [t for t in brute.awkward() if t is None or len(t) < 20_000]
    d = brute.docs(spark, texts, start=100).orderBy(F.rand(1)).repartition(3)
    d = d.unionByName(d.where("doc_id = 105"))
    folder = f"file://{tmp_path}/ids"
    files = token_files.write_token_files(d, P.path("byte_bpe_50k.json"), folder, partitions=3)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in token_files.read_token_files(files, folder).collect()), key=lambda r: r[1])
    own, at, want = Ids(P.path("byte_bpe_50k.json")), 0, []
    for i, t in sorted([*((k + 100, t) for k, t in enumerate(texts)), (105, texts[5])], key=lambda x: x[0]):
        ids = own.library(t or "") + (2).to_bytes(4, "little")
        want.append((i, at, len(ids) // 4, ids))
        at += len(ids) // 4
    assert got == want
    name = sorted(r["file"] for r in files.collect() if r["n_docs"])[0]
    f = token_files.TokenFile(f"{folder}/{name}")
    assert f.find(100) == [want[0][3]] and f.find(99) == []
    raw = (tmp_path / "ids" / name).read_bytes()
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert plain == b"".join(f.ids(k) for k in range(len(f)))
    broken = bytearray(raw)
    broken[f.starts[1] - 6] ^= 1
    (tmp_path / "ids" / "bad").write_bytes(broken)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.TokenFile(f"{folder}/bad").ids(0)


def fewest(sizes, capacity):
    """The least number of bins, by trying all."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in sorted({(b, j) for j, b in enumerate(bins)}, reverse=True):
            if k[0] >= sizes[i]:
                bins[k[1]] -= sizes[i]
                go(i + 1, bins)
                bins[k[1]] += sizes[i]
        bins.append(capacity - sizes[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best


def expand(patterns):
    return [sorted(w for w, k in p.items() for _ in range(k)) for p, n in patterns for _ in range(n)]


def test_reduction_keeps_an_optimal_packing():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        counts = {w: sizes.count(w) for w in sizes}
        fixed, rest = packing.reduce(counts, 20)
        left = [w for w, n in rest.items() for _ in range(n)]
        assert sorted([w for b in expand(fixed) for w in b] + left) == sorted(sizes)
        assert sum(n for _, n in fixed) + (fewest(left, 20) if left else 0) == fewest(sizes, 20)
        packed = expand(packing.pack_lengths(counts, 20))
        assert all(sum(b) <= 20 for b in packed) and sorted(w for b in packed for w in b) == sorted(sizes)


def test_no_packing_is_under_the_bound():
    rng = random.Random(4)
    met = 0
    for _ in range(200):
        capacity = rng.choice([12, 20, 31])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = {w: sizes.count(w) for w in sizes}
        best, bound = fewest(sizes, capacity), packing.lower_bound(counts, capacity)
        assert bound <= best <= sum(n for _, n in packing.pack_lengths(counts, capacity))
        met += bound == best
    assert met > 180
    assert packing.lower_bound({}, 20) == 0


def test_pairs_and_triples_are_fixed():
    # 11 takes the 6 and the 3: no other pair fits better, and three others don't fit
    assert packing.reduce({11: 1, 6: 1, 3: 2}, 20)[0][0] == ({11: 1, 6: 1, 3: 1}, 1)
    # 12 takes the 8 rather than 4 and 3
    assert packing.reduce({12: 5, 7: 5, 4: 1, 3: 3}, 20)[0][0] == ({12: 1, 7: 1}, 5)


def test_places_are_gapless():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 60, 3000)
    patterns = packing.pack_lengths({int(w): int(n) for w, n in zip(*np.unique(lengths, return_counts=True), strict=True)}, 64)
    rank, seen = [], {}
    for w in lengths.tolist():
        rank.append(seen.get(w, 0))
        seen[w] = rank[-1] + 1
    s, o = packing.Places(patterns).of(lengths, np.array(rank))
    by = {}
    for a, b, w in zip(s.tolist(), o.tolist(), lengths.tolist(), strict=True):
        by.setdefault(a, []).append((b, w))
    for rows in by.values():
        at = 0
        for b, w in sorted(rows):
            assert b == at
            at += w
        assert at <= 64
    assert len(by) == sum(n for _, n in patterns) <= -(-int(lengths.sum()) // 64) * 1.03
    assert list(combinations_with_replacement([1], 1))


def test_packing_holds_every_id(spark):
    texts = brute.awkward()
    pieces, placed = packing.pack_documents(brute.docs(spark, texts), P.path("word_bpe_49k.json"), capacity=512)
    own = Ids(P.path("word_bpe_49k.json"))
    by = {}
    for r in sorted(pieces.collect(), key=lambda r: r["piece"]):
        by[r["doc_id"]] = by.get(r["doc_id"], b"") + bytes(r["ids"])
    assert by == {i: own.library(t or "") + b"\x01\0\0\0" for i, t in enumerate(texts)}
    got = placed.toPandas()
    for (d, k), g in got.groupby(["doc_id", "piece"]):
        ids = by[d][k * 2048 : (k + 1) * 2048]
        assert (g["ids_crc32"] == zlib.crc32(ids)).all() and (g["start"] == 512 * k).all() and (g["length"] == len(ids) // 4).all()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= 512
    assert packing.pack_documents(brute.docs(spark, []), P.path("word_bpe_49k.json"))[1].count() == 0


def _differences(loss, arrays, grads, rng, step):
    """Gradients against central differences of some numbers of each array; kinks of piecewise linear functions may spoil a few."""
    good = total = 0
    for q, g in zip(arrays, grads, strict=True):
        for at in rng.choice(q.size, min(12, q.size), replace=False):
            old = q.flat[at]
            q.flat[at] = old + step
            hi = loss()
            q.flat[at] = old - step
            lo = loss()
            q.flat[at] = old
            good += abs((hi - lo) / (2 * step) - g.flat[at]) <= 1e-5 * max(1, abs(g.flat[at])) + 1e-7
            total += 1
    return good / total


def test_backpropagation_through_time_matches_differences():
    rng = np.random.default_rng(0)
    net = language.new_net(["a", "b", "c"], hidden=5, seed=3)
    for p in (net.tables, net.recur, net.out):
        p[:] = [q.astype(np.float64) for q in p]
    net.bias = net.bias.astype(np.float64)
    x = rng.integers(0, 12, (20, 7))
    x[15:, 3] = language._PAD
    for t in net.tables:
        t[:12] += rng.normal(0, 0.3, t[:12].shape)
    y = rng.integers(0, 3, 7)
    loss, grads = language.gradients(net, x, y)
    assert loss > 0
    for p, g in zip(net.tables, grads, strict=False):  # rows of bytes that occur
        assert _differences(lambda: language.gradients(net, x, y)[0], [p[:12]], [g[:12]], rng, 1e-6) >= 0.9
    assert _differences(lambda: language.gradients(net, x, y)[0], net.params()[2:], grads[2:], rng, 1e-6) >= 0.9


def test_training_lowers_the_loss():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(97, 105, (40, 48)), rng.integers(103, 112, (40, 48))]).astype(np.int16)
    y = np.repeat([0, 1], 40)
    start = language.gradients(language.new_net(["a", "b"]), x.T, y)[0]
    assert language.gradients(language.train(x, y, ["a", "b"], steps=60, batch=32), x.T, y)[0] < 0.2 < start


def test_ordinal_gradients_match_differences():
    rng = np.random.default_rng(2)
    rows = [rng.choice(30, rng.integers(1, 9), replace=False) for _ in range(50)]
    flat, owner = np.concatenate(rows), np.repeat(np.arange(50), [len(r) for r in rows])
    grades, weight = rng.integers(0, 3, 50), rng.random(50)
    w, raw = rng.normal(0, 1, 30), np.array([-0.4, 0.3])
    own = lambda: quality.gradients(w, raw, flat, owner, grades, weight, 0.01)
    assert _differences(lambda: own()[0], [w, raw], own()[1:], rng, 1e-6) == 1


def test_thresholds_are_the_bases_without_features():
    grades = np.array([0] * 20 + [1] * 30 + [2] * 50)
    model = quality.train([np.zeros(0, np.int64)] * 100, grades, bits=4, steps=3000, ridge=0)
    weight = np.array([20, 30, 50]) ** 0.5  # rows of a grade weigh 1 / sqrt(share), together sqrt(share)
    want = [weight[1:].sum() / weight.sum(), weight[2] / weight.sum()]
    assert np.allclose(model.tails(np.zeros(0, np.int64)), want, atol=0.01)


@needs_data
def test_language_on_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(d, language.fit(d)).join(d.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert len(held) > 250 and (held["lang"] == held["lang_pred"]).mean() >= 0.97
    assert got["score"].between(0, 1).all()


def test_language_of_awkward_texts(spark):
    texts = [*brute.PROSE * 4, *brute.awkward(), "12 34 --", None, "½", "² Ⅷ ٣ ⑤ _", "ʰ", "一", "1a"]
    d = brute.docs(spark, texts)
    got = {r["doc_id"]: r for r in language.identify(d, language.fit(d)).collect()}
    for i, t in enumerate(texts):
        assert (got[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")), t
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    none = d.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(none, language.fit(none)).collect()} == {"und"}
    both = d.unionByName(d.withColumn("doc_id", F.lit(None).cast("long")))
    left = language.keep_known(both, min_score=0.0)
    assert left.columns == d.columns
    named = sorted(t or "" for t in texts if any(c.isalpha() for c in t or ""))
    assert sorted(r["text"] for r in left.where("doc_id is null").collect()) == sorted(r["text"] for r in left.where("doc_id is not null").collect()) == named
    assert language.identify(d.limit(0), None).count() == 0


def test_pieces_cover_whole_texts():
    net = language.new_net(["a", "b", "c"])
    texts = [b"", b"x", b"ab" * 500, b"q" * 256, b"z" * 257]
    p = language.document_probabilities(net, texts, rows=3)
    assert p[0].sum() == 0 and np.allclose(p[1:].sum(1), 1)
    for i, t in enumerate(texts):
        assert np.allclose(language.document_probabilities(net, [t])[0], p[i], atol=1e-6)


@needs_data
def test_pieces_start_with_the_state_of_the_whole_text_before(spark):
    """Against one run over the whole text in each direction."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language.fit(d)
    texts = [r["text"].encode() for r in d.where("length(text) > 3000").orderBy("doc_id").limit(15).collect()]
    got = language.document_probabilities(net, texts)
    for t, p in zip(texts, got, strict=True):
        x = np.frombuffer(t, np.uint8)[:, None]
        f, b = language._states(net.tables[0], net.recur[0], x, False)[0][1:], language._states(net.tables[1], net.recur[1], x[::-1], False)[0][1:][::-1]
        z = f @ net.out[0] + b @ net.out[1] + net.bias
        q = np.exp(z - z.max(-1, keepdims=True))
        q = (q / q.sum(-1, keepdims=True)).mean((0, 1))
        assert np.abs(p - q).max() < 0.02


BIG = (1 << 60) + 1


def test_long_ids_survive_beside_nulls(spark):
    """No operator may round an id because another row has none."""
    from mnemoria.llm import chat, cover_tree, decontaminate, lines, secrets, simhash  # noqa: F401

    rows = [(BIG, brute.PROSE[0], "en"), (None, brute.PROSE[1], "de"), (BIG + 1, brute.PROSE[2], "es"), (None, None, None), (7, "x y z a b", "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    ids = sorted(r[0] or 0 for r in rows)
    own = lambda df, name="doc_id": sorted(r[name] or 0 for r in df.select(name).collect())
    items = spark.createDataFrame([(BIG + 2, "quick brown fox jumps over the lazy dog")], "item_id long, text string")
    found = decontaminate.leaks(d, items).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(BIG, BIG + 2)]
    assert own(decontaminate.drop_leaks(d, items)) == [0, 0, 7, BIG + 1]
    assert own(language.identify(d, language.fit(d))) == ids
    assert own(simhash.near_duplicates(d)) == ids
    assert own(simhash.near_duplicates(d).where("doc_id is not null"), "component_id") == [7, BIG, BIG + 1]
    assert own(packing.pack_documents(d, P.path("word_bpe_49k.json"))[1]) == ids
    assert own(quality.classify(d, spark.createDataFrame([(BIG, 1, 0), (BIG + 1, 0, 0)], "doc_id long, quality int, toxic int"))) == ids
    assert own(lines.drop_recurring(d)) == ids and own(secrets.scan(d)) == ids


@needs_data
def test_quality_on_documents_it_was_not_fitted_to(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rated = quality.graded(labels)
    model = quality.fit(d, rated, keep="doc_id % 2 = 0")
    got = quality.score(d, model).join(rated.where("doc_id % 2 = 1"), "doc_id").toPandas()
    good = got["grade"] == 2
    assert (got[good]["p_good"] >= 0.5).mean() >= 0.95  # about 2,000 rated rows to learn from; a corpus has more
    assert (got[~good]["p_good"] < 0.5).mean() >= 0.8
    assert np.all(np.diff(model.thetas) > 0)


def test_quality_without_ratings_keeps_all(spark):
    d = brute.docs(spark, brute.awkward())
    none = spark.createDataFrame([(1, None, 0), (None, 1, 1), (77, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(d, none).collect()
    assert len(got) == len(brute.awkward()) and all(r["kept"] for r in got)
    some = spark.createDataFrame([(i, i % 2, int(i == 4)) for i in range(13)] * 2, "doc_id long, quality int, toxic int")
    assert quality.classify(d, some).count() == len(brute.awkward())


@needs_data
def test_pipeline_end_to_end(spark):
    import corpus_pipeline
    from mnemoria.llm.decontaminate import normalise

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.toPandas().set_index("doc_id")
    items = [normalise(t) for t in spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()["text"]]
    d, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = spark.createDataFrame(stage(spark, d, SF).toPandas(), docs.schema)
        assert d.columns == docs.columns
        kept.append(d.toPandas().set_index("doc_id"))
    lang, line, near, clean = kept
    assert len(lang) >= 0.97 * len(first)
    want = brute.line_dedup(sorted(lang["text"].items()), least=1)
    assert line["text"].to_dict() == want
    fp = {i: brute.simhash(t) for i, t in line["text"].items()}
    c = brute.components(fp, [(i, j) for i in fp for j in fp if i > j and (fp[i] ^ fp[j]).bit_count() <= 2])
    assert set(near.index) == set(c.values())
    assert set(clean.index) == {i for i, t in near["text"].items() if not any(x in normalise(t) for x in items)}
    packed = corpus_pipeline.run(spark, SF).toPandas()
    assert set(packed["doc_id"]) == set(clean.index)
    assert (packed.groupby("sequence_id")["length"].sum() <= 4096).all()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "decontamination", "best_fit_packing"]


@needs_data
def test_pipeline_on_awkward_rows(spark, tmp_path):
    """Nulls in any column, empty, repeated and very long rows, columns with the operators' own names, and no rows."""
    import corpus_pipeline

    item = "what is the capital city of the country that lies north of the great river"
    prose = [" ".join(random.Random(k).choices(" ".join(brute.PROSE).split(), k=60)) for k in range(12)]
    rows = [(k, t, ("en", "de", "es")[k % 3] if k % 5 else None, None, None, 99, "x") for k, t in enumerate(prose)]
    rows += [(None, prose[0], None, None, None, None, None), (3, prose[3], "en", None, None, None, None), (3, prose[4] + " und more", "en", None, None, None, None)]
    rows += [(BIG, item.upper() + " and so on", "en", "s", 1, 1, "y"), (None, "so " + item, "en", "s", 1, 1, "y"), (BIG + 1, prose[5] + "\n" + "long tail of words " * 20_000, "en", "s", 1, 1, "y")]
    rows += [(50 + k, t, "en", None, None, None, None) for k, t in enumerate([None, "", " \n ", "½ 12", "--"])]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_lines int, at string")
    d.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "x"), (3, "")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    sf = f"file://{tmp_path}"
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = packing.materialize(stage(spark, d, sf), name)
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "at"]
        kept[name] = d.collect()
    assert not {r["doc_id"] for r in kept["language_id"]} & set(range(50, 55))
    assert {r["n_lines"] for r in kept["line_dedup"] if r["doc_id"] in range(12)} >= {99}
    ids = [r["doc_id"] for r in kept["decontamination"]]
    assert BIG not in ids and BIG + 1 in ids and ids.count(3) <= 2
    assert not any(item in r["text"].lower() for r in kept["decontamination"])
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in packed} == set(ids)
    empty = f"file://{tmp_path}/empty"
    spark.createDataFrame([], d.schema).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_token_queries_against_an_untouched_library(spark, tmp_path):
    texts = [*(t for t in brute.awkward() if t is None or len(t) < 120_000), "say <|endoftext|> now <|startoftext|>", "a\x1cb  c d", " ".join(brute.PROSE * 150)]
    brute.docs(spark, texts, start=BIG).repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    sf = f"file://{tmp_path}"
    library = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    start = 0
    got = token_files.op6_token_files(spark, sf).orderBy("start").collect()
    for k, (r, t) in enumerate(zip(got, texts, strict=True)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (BIG + k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    library = Tokenizer.from_file(str(P.path("word_bpe_49k.json")))
    placed = packing.op8_packing(spark, sf)
    got = placed.orderBy("doc_id", "piece").collect()
    want = []
    for k, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(BIG + k, p, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for p, at in enumerate(range(0, len(ids), 4096))]
    assert [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got] == want and len(want) > len(texts)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for rows in by.values():
        ends = [0, *np.cumsum([n for _, n in sorted(rows)]).tolist()]
        assert [o for o, _ in sorted(rows)] == ends[:-1] and ends[-1] <= 4096
    r = packing.report(placed).first()
    assert (r["pieces"], r["tokens"], r["sequences"]) == (len(want), sum(w[3] for w in want), len(by)) and r["lower_bound"] <= r["sequences"]


def test_empty_tables(spark, tmp_path):
    none = brute.docs(spark, [])
    folder = f"file://{tmp_path}/ids"
    files = token_files.write_token_files(none, P.path("byte_bpe_50k.json"), folder, partitions=2)
    assert token_files.read_token_files(files, folder).count() == 0
    assert quality.classify(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    assert packing.pack_documents(none, P.path("word_bpe_49k.json"))[1].count() == 0
    assert language.keep_known(none).count() == 0
