"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= k) = 1 / (1 + exp(-(w.x - theta_k))): one set of weights over hashed text, ordered thresholds. A document's
grades give its expected grade and the probability of the top grade, by which it is selected.
Features are the distinct tokens of the whole text, how words begin, and shares of kinds of tokens, all hashed.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import over_texts

#: Hashed weights; labelled rows that a fit reads at most, about; tokens in a smaller share of the fitted rows carry no weight.
BITS, FIT_ROWS, MIN_SHARE = 18, 8_000, 0.001
GRADES = 3
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_USUAL = frozenset([".", ",", ";", ":", "!", "?", "'", '"', "-", "(", ")", ".,"])


class Features:
    """Hashed features of a text, as sorted distinct ints. Tokens met before are remembered, a bounded number of them."""

    def __init__(self, bits: int = BITS) -> None:
        self.mask = (1 << bits) - 1
        self.memo: dict[str, list[int]] = {}

    def _hash(self, feature: str) -> int:
        return zlib.crc32(feature.encode("utf-8", "replace")) & self.mask

    def _token(self, t: str) -> list[int]:
        """A token and, for a word, how it begins: that is what forms of a word share."""
        return [self._hash("w:" + t), *([self._hash(f"{n}:" + t[:n]) for n in (4, 5) if len(t) > n] if t[0].isalpha() else [])]

    def of(self, text: str | None) -> np.ndarray:
        tokens = _TOKEN.findall(text) if text else []
        low = [t.lower() for t in tokens]
        distinct = set(low)
        memo = self.memo
        if len(memo) > 200_000:
            memo.clear()
        own: list[int] = []
        for t in distinct:
            k = memo.get(t)
            if k is None:
                k = memo[t] = self._token(t)
            own += k
        n = len(tokens) or 1
        odd = sum(not t[0].isalnum() and t not in _USUAL for t in tokens)
        shares = {"odd": odd, "upper": sum(len(t) > 1 and t.isupper() for t in tokens), "distinct": len(distinct), "again": sum(a == b for a, b in zip(low, low[1:], strict=False)), "digits": sum(t[0].isdigit() for t in tokens)}
        own += [self._hash(f"share {k}:{round(8 * math.sqrt(v / n))}") for k, v in shares.items()]
        own.append(self._hash(f"size {min(4, n // 8)}"))
        return np.unique(np.array(own, np.int32))


@dataclass
class Model:
    weights: np.ndarray
    thetas: np.ndarray  # ascending

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), … of one text's features."""
        s = float(self.weights[x].sum())
        return 1.0 / (1.0 + np.exp(np.clip(self.thetas - s, -50, 50)))


def gradients(w: np.ndarray, raw: np.ndarray, flat: np.ndarray, owner: np.ndarray, grades: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted negative log likelihood with the ridge, and its gradients for ``w`` and ``raw``; row owner[i] has feature flat[i].

    ``raw`` is the first threshold and the logarithms of the steps to the next ones, which keeps thresholds ordered.
    """
    theta = np.concatenate([raw[:1], raw[:1] + np.cumsum(np.exp(raw[1:]))])
    s = np.bincount(owner, w[flat], len(grades))
    cdf = 1 / (1 + np.exp(np.clip(s[:, None] - theta, -50, 50)))  # P(grade < k+1)
    full = np.concatenate([np.zeros((len(s), 1)), cdf, np.ones((len(s), 1))], 1)
    at = np.arange(len(s))
    hi, lo = full[at, grades + 1], full[at, grades]
    p = np.maximum(hi - lo, 1e-9)
    g_s = (hi * (1 - hi) - lo * (1 - lo)) / p * weight
    slope = cdf * (1 - cdf) / p[:, None] * weight[:, None]
    g_theta = np.array([slope[grades == k + 1, k].sum() - slope[grades == k, k].sum() for k in range(len(theta))])
    g_raw = np.concatenate([[g_theta.sum()], [g_theta[j:].sum() * math.exp(raw[j]) for j in range(1, len(raw))]])
    loss = -float((np.log(p) * weight).sum()) + ridge / 2 * float(w @ w)
    return loss, np.bincount(flat, g_s[owner], len(w)) + ridge * w, g_raw


def train(rows: list[np.ndarray], grades: np.ndarray, bits: int = BITS, steps: int = 150, ridge: float = 1e-3, min_share: float = MIN_SHARE) -> Model:
    """Adam on the class-weighted likelihood."""
    size = 1 << bits
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    known = np.bincount(flat, minlength=size) >= min_share * len(rows)
    owner = np.repeat(np.arange(len(rows)), lengths)[known[flat]]
    flat = flat[known[flat]]
    share = np.bincount(grades, minlength=GRADES) / len(grades)
    weight = 1.0 / np.sqrt(np.maximum(share[grades], 1e-6))
    weight /= weight.sum()
    w, raw = np.zeros(size), np.zeros(GRADES - 1)
    m, v = [np.zeros(size), np.zeros_like(raw)], [np.zeros(size), np.zeros_like(raw)]
    for step in range(1, steps + 1):
        _, *grads = gradients(w, raw, flat, owner, grades, weight, ridge)
        for k, (q, g) in enumerate(zip((w, raw), grads, strict=True)):
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            q -= 0.03 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return Model(w.astype(np.float32), np.concatenate([raw[:1], raw[:1] + np.cumsum(np.exp(raw[1:]))]))


def graded(labels: DataFrame) -> DataFrame:
    """``(doc_id, grade)``: 0 toxic, 1 of low quality, 2 good. Rows with a null are no ratings; of several, the lowest counts."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).alias("grade"))


def _hashed(docs: DataFrame, *more: str) -> DataFrame:
    def make():  # noqa: ANN202
        features = Features()
        return lambda texts: (None, [[features.of(t) for t in texts]])

    return over_texts(docs, make, "x array<int>", ("doc_id", *more))


def fit(docs: DataFrame, ratings: DataFrame, fit_rows: int = FIT_ROWS, keep: str = "true") -> Model | None:
    """Fit to about ``fit_rows`` rated documents, picked by a hash of their ids. None without two grades."""
    rated = ratings.where(keep)
    n = rated.count()
    if not n:
        return None
    picked = rated.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, fit_rows / n)))
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(picked.select("doc_id", "grade"), "doc_id")
    got = _hashed(rows, "grade").orderBy("doc_id").limit(2 * fit_rows).toPandas()
    if got["grade"].nunique() < 2:
        return None
    return train(list(got["x"]), got["grade"].to_numpy(np.int64))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, expected_grade, p_low_or_better, p_good)`` for every row of ``docs(doc_id, text)``, over whole texts.

    A null text is an empty one. Without a model all are null.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():  # noqa: ANN202
        features, own = Features(), sent.value

        def of(texts: list[str | None]):  # noqa: ANN202
            if own is None:
                return None, [[None] * len(texts)] * 3
            tails = np.array([own.tails(features.of(t)) for t in texts]).reshape(len(texts), -1)
            return None, [tails.sum(1), tails[:, 0], tails[:, 1]]

        return of

    return over_texts(docs, make, "expected_grade double, p_low_or_better double, p_good double")


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``score`` of a model fitted to ``labels``, and ``kept``: the top grade is at least as likely as ``least``. Without a model all are kept."""
    scored = score(docs, fit(docs, graded(labels)))
    return scored.withColumn("kept", F.coalesce(F.col("p_good") >= least, F.lit(True)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import table

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
