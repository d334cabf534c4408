"""Language ID by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in both directions, labels every position, and a document's probabilities are the
mean over all its positions. It is trained here, in numpy, by backpropagation through time on a bounded sample.
Gates and candidates are piecewise linear, which numpy evaluates several times faster than exponentials.

A text is labelled in pieces, many side by side. Each direction first reads the bytes that come before the piece in its sense, so a piece starts with
the state that the whole text before it leaves, but for what it has forgotten: the gate that keeps the state is bounded.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import keep_rows, materialize, over_texts

HIDDEN = 8
#: Bytes that are labelled side by side, and bytes before (and behind) them that are read first: what lies further off weighs nothing.
PIECE, CONTEXT, TRAIN_PIECE = 256, 64, 48
#: The most of its state that a step may keep. It makes the network forget: 0.8 ** CONTEXT is under a millionth.
KEEP = np.float32(0.8)
#: Documents of each language whose whole texts are cut into pieces for the fit, about; such pieces of each language that it holds at most; steps.
FIT_DOCS, FIT_PIECES, STEPS, BATCH = 400, 20_000, 260, 256
UNKNOWN = "und"
_PLAIN_LETTER = re.compile(r"[A-Za-z]")
_PAD = 256


@dataclass
class Net:
    langs: list[str]
    tables: list[np.ndarray]  # a direction each: (257, 3H) inputs' part of the gates r, z and the candidate
    recur: list[np.ndarray]  # (H, 3H)
    out: list[np.ndarray]  # (H, L)
    bias: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [*self.tables, *self.recur, *self.out, self.bias]


def new_net(langs: list[str], hidden: int = HIDDEN, seed: int = 7) -> Net:
    rng = np.random.default_rng(seed)
    make = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
    net = Net(langs, [make(257, 3 * hidden, s=0.3) for _ in "ab"], [make(hidden, 3 * hidden, s=0.5 / hidden**0.5) for _ in "ab"], [make(hidden, len(langs), s=0.3) for _ in "ab"], np.zeros(len(langs), np.float32))
    _hold(net)
    return net


def _hold(net: Net) -> None:
    """Padding says nothing: a zero state stays zero over it."""
    for t in net.tables:
        t[_PAD] = 0


def _states(table: np.ndarray, recur: np.ndarray, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States after each step for bytes ``x`` (steps, rows)."""
    h = recur.shape[0]
    steps, rows = x.shape
    s = np.zeros((steps + 1, rows, h), table.dtype)
    most = np.array([1] * h + [KEEP] * h, table.dtype)
    tape = []
    for t in range(steps):
        gx, gh = table[x[t]], s[t] @ recur
        rz_raw = gx[:, : 2 * h] + gh[:, : 2 * h] + 0.5
        rz = np.minimum(np.maximum(rz_raw, 0), most)
        r, z = rz[:, :h], rz[:, h:]
        n_raw = gx[:, 2 * h :] + r * gh[:, 2 * h :]
        n = np.clip(n_raw, -1, 1)
        s[t + 1] = n + z * (s[t] - n)
        if keep:
            tape.append((rz == rz_raw, r, z, n == n_raw, n, gh[:, 2 * h :]))
    return s, tape


def gradients(net: Net, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy of all positions of bytes ``x`` (steps, rows) with labels ``y``, and its gradient for each of ``net.params()``."""
    h = net.recur[0].shape[0]
    runs = [_states(net.tables[0], net.recur[0], x, True), _states(net.tables[1], net.recur[1], x[::-1], True)]
    f, b = runs[0][0][1:], runs[1][0][1:][::-1]
    logits = f @ net.out[0] + b @ net.out[1] + net.bias
    p = np.exp(logits - logits.max(-1, keepdims=True))
    p /= p.sum(-1, keepdims=True)
    real = (x != _PAD).astype(p.dtype)
    real /= real.sum()
    own = np.arange(len(y))
    loss = -float((np.log(p[:, own, y]) * real).sum())
    p[:, own, y] -= 1
    d = p * real[..., None]
    grads: list[np.ndarray] = [None] * 7
    grads[6] = d.sum((0, 1))
    for k, states in enumerate((f, b)):
        grads[4 + k] = np.einsum("tbh,tbl->hl", states, d, optimize=True)
    for k in (0, 1):
        s, tape = runs[k]
        xs = x if k == 0 else x[::-1]
        ds_out = (d if k == 0 else d[::-1]) @ net.out[k].T
        g_table, g_recur, carry = np.zeros_like(net.tables[k]), np.zeros_like(net.recur[k]), np.zeros_like(s[0])
        for t in range(len(xs) - 1, -1, -1):
            rz_in, r, z, n_in, n, gh_n = tape[t]
            ds = ds_out[t] + carry
            dn = ds * (1 - z) * n_in
            dz = ds * (s[t] - n) * rz_in[:, h:]
            dr = dn * gh_n * rz_in[:, :h]
            dx = np.concatenate([dr, dz, dn], 1)
            dg = np.concatenate([dr, dz, dn * r], 1)
            g_recur += s[t].T @ dg
            np.add.at(g_table, xs[t], dx)
            carry = ds * z + dg @ net.recur[k].T
        grads[k], grads[2 + k] = g_table, g_recur
    return loss, grads


def train(segments: np.ndarray, labels: np.ndarray, langs: list[str], steps: int = STEPS, batch: int = BATCH, seed: int = 7) -> Net:
    """Adam on the mean cross entropy of all positions of ``segments`` (rows, TRAIN_PIECE) of bytes or padding."""
    net = new_net(langs, seed=seed)
    rng = np.random.default_rng(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.params()]
    groups = [np.flatnonzero(labels == k) for k in range(len(langs))]
    groups = [g for g in groups if len(g)]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(g, max(1, batch // len(groups))) for g in groups])
        _, grads = gradients(net, segments[pick].T, labels[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * min(1.0, 3 * (1 - step / (steps + 1)))
        for q, g, (m, v) in zip(net.params(), grads, moments, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        _hold(net)
    return net


def _pass(table: np.ndarray, recur: np.ndarray, out: np.ndarray, x: np.ndarray, logits: np.ndarray, backward: bool) -> None:
    """Add a direction's part to ``logits`` (PIECE, rows, L) of bytes ``x`` (CONTEXT + PIECE + CONTEXT, rows)."""
    h = recur.shape[0]
    rows = x.shape[1]
    s = np.zeros((rows, h), np.float32)
    gx, gh = np.empty((rows, 3 * h), np.float32), np.empty((rows, 3 * h), np.float32)
    part = np.empty((rows, out.shape[1]), np.float32)
    rz, n = np.empty((rows, 2 * h), np.float32), np.empty((rows, h), np.float32)
    most = np.array([1] * h + [KEEP] * h, np.float32)
    for t in range(len(x) - 1, CONTEXT - 1, -1) if backward else range(CONTEXT + PIECE):
        np.take(table, x[t], axis=0, out=gx, mode="clip")
        np.matmul(s, recur, out=gh)
        np.add(gx[:, : 2 * h], gh[:, : 2 * h], out=rz)
        np.maximum(rz, 0, out=rz)
        np.minimum(rz, most, out=rz)
        np.multiply(rz[:, :h], gh[:, 2 * h :], out=n)
        n += gx[:, 2 * h :]
        np.maximum(n, -1, out=n)
        np.minimum(n, 1, out=n)
        s -= n
        s *= rz[:, h:]
        s += n
        if CONTEXT <= t < CONTEXT + PIECE:
            np.matmul(s, out, out=part)
            logits[t - CONTEXT] += part


def document_probabilities(net: Net, texts: list[bytes], rows: int = 1024) -> np.ndarray:
    """(documents, languages): the mean over all positions of each text's label probabilities; zeros for empty texts.

    ``rows`` pieces are held at a time, however long a text is.
    """
    total = np.zeros((len(texts), len(net.langs)), np.float64)
    h = net.recur[0].shape[0]
    tables = [t.copy() for t in net.tables]
    for t in tables:
        t[:, : 2 * h] += 0.5
    width = CONTEXT + PIECE + CONTEXT
    block, owner, held = np.empty((rows, width), np.int16), np.empty(rows, np.int64), 0

    def flush() -> None:
        x = np.ascontiguousarray(block[:held].T)
        logits = np.empty((PIECE, held, len(net.langs)), np.float32)
        logits[:] = net.bias
        for k in (0, 1):
            _pass(tables[k], net.recur[k], net.out[k], x, logits, k == 1)
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(-1, keepdims=True)
        logits *= (x[CONTEXT : CONTEXT + PIECE] != _PAD)[..., None]
        np.add.at(total, owner[:held], logits.sum(0, dtype=np.float64))

    for i, text in enumerate(texts):
        own = np.frombuffer(text, np.uint8)
        for at in range(0, len(own), PIECE):
            lo, hi = max(0, at - CONTEXT), min(len(own), at + PIECE + CONTEXT)
            row = block[held]
            row[: CONTEXT - at + lo] = _PAD
            row[CONTEXT - at + lo : CONTEXT - at + hi] = own[lo:hi]
            row[CONTEXT - at + hi :] = _PAD
            owner[held] = i
            held += 1
            if held == rows:
                flush()
                held = 0
    if held:
        flush()
    sizes = np.array([len(t) for t in texts], np.int64)
    return total / np.maximum(sizes, 1)[:, None]


def fold(doc_id: object) -> object:
    """crc32 of the doc_id as text, modulo 3; fold 1 is held out of every fit."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 if isinstance(doc_id, str) else doc_id


def has_letter(text: str | None) -> bool:
    """Whether a character is a letter (categories L*): digits of any script, fractions and numerals are none."""
    return bool(text) and (_PLAIN_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def _pieces(text: str | None) -> np.ndarray:
    """(pieces, TRAIN_PIECE): all bytes of a text, padding behind the last."""
    x = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    n = -(-len(x) // TRAIN_PIECE)
    block = np.full(n * TRAIN_PIECE, _PAD, np.int16)
    block[: len(x)] = x
    return block.reshape(n, TRAIN_PIECE)


def _share(rows: DataFrame, most: int, *key: str) -> DataFrame:
    """About ``most`` rows of each language, by a hash of ``key``. Languages are the network's outputs, so their counts are few."""
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, most / r["n"])))]) if counts else F.create_map().cast("map<string,double>")
    return rows.where((F.pmod(F.xxhash64(*key, F.lit("fit")), F.lit(1_000_000)) / 1_000_000.0) < F.element_at(share, F.col("lang")))


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, fit_pieces: int = FIT_PIECES) -> Net | None:
    """Train on the whole texts of about ``fit_docs`` documents of each language, none held out.

    Their pieces are cut in the tasks; of a language with more than ``fit_pieces`` about so many stay, picked by a hash. None if no row
    has a text, a language and a doc_id.
    """
    known = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null and doc_id is not null and length(text) > 0")
    known = known.where(F.coalesce(fold("doc_id") != 1, F.lit(False)))
    picked = _share(known, fit_docs, "doc_id")

    def make():  # noqa: ANN202
        def of(texts: list[str | None]):  # noqa: ANN202
            cut = [_pieces(t) for t in texts]
            return [i for i, c in enumerate(cut) for _ in range(len(c))], [[row.tobytes() for c in cut for row in c], [k for c in cut for k in range(len(c))]]

        return of

    pieces = materialize(over_texts(picked, make, "piece binary, nth int", ("doc_id", "lang")), "fit")
    few = _share(pieces, fit_pieces, "doc_id", "nth")
    rows = few.select("lang", "piece").orderBy("lang", "doc_id", "nth", "piece").toArrow()
    if not rows.num_rows:
        return None
    names = rows["lang"].to_pylist()
    langs = sorted(set(names))
    at = {k: i for i, k in enumerate(langs)}
    return train(np.frombuffer(b"".join(rows["piece"].to_pylist()), np.int16).reshape(-1, TRAIN_PIECE), np.array([at[k] for k in names]), langs)


def _labels(net: Net | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The language of each text and its score; UNKNOWN and 0 without a letter or without a net."""
    readable = [net is not None and has_letter(t) for t in texts]
    if not any(readable):
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    p = document_probabilities(net, [t.encode("utf-8", "replace") if ok else b"" for t, ok in zip(texts, readable, strict=True)])
    lang = [net.langs[k] if ok else UNKNOWN for k, ok in zip(p.argmax(1).tolist(), readable, strict=True)]
    return lang, np.where(readable, np.clip(p.max(1), 0, 1), 0.0)


def identify(docs: DataFrame, net: Net | None) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row of ``docs(doc_id, text)``.

    Every byte of every text is read and labelled. ``und`` with score 0 where the text is null or has no letter, or where
    there is no net. Neither lang nor source nor doc_id is read by a prediction. A null doc_id is not held out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def make():  # noqa: ANN202
        own = sent.value
        return lambda texts: (None, list(_labels(own, texts)))

    found = over_texts(docs, make, "lang_pred string, score double")
    return found.select("doc_id", F.coalesce(fold("doc_id") == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import table

    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


def keep_known(docs: DataFrame, min_score: float = 0.4) -> DataFrame:
    """``docs`` without the rows in no language that the net knows: ``und``, or a score under ``min_score``.

    Rows are judged as they pass, so an id need not be there or be unique, and nothing is joined.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def make():  # noqa: ANN202
        own = sent.value

        def keep(texts: list[str | None]) -> list[bool]:
            lang, score = _labels(own, texts)
            return [k != UNKNOWN and s >= min_score for k, s in zip(lang, score.tolist(), strict=True)]

        return keep

    return keep_rows(docs, make)
