"""Scores that depend on time, authority and use. ``now`` is always a parameter."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400.0
WEEK_RATE = math.log(2) / (7 * DAY)


def recency(timestamp: Column, now: float, half_life: float = DAY) -> Column:
    """1 now, a half after each half-life; a future time is now. The half-life is a second at least."""
    age = F.greatest(F.lit(now) - timestamp, F.lit(0.0))
    return F.pow(F.lit(2.0), -age / max(half_life, 1.0))


def authority(channel: Column) -> Column:
    return F.when(channel == "user_correction", 1.0).when(channel == "conversation", 0.7).when(channel == "system", 0.4).otherwise(0.2)


def rerank_score(timestamp: Column, channel: Column, activation: Column, now: float, weights: tuple[float, float, float] = (0.3, 0.2, 0.5), half_life: float = DAY) -> Column:
    r, a, u = weights
    return r * recency(timestamp, now, half_life) + a * authority(channel) + u * F.least(F.greatest(activation, F.lit(0.0)), F.lit(1.0))


def temporal_boost(timestamp: Column, kind: str, now: float, lo: float = 0.0, hi: float = 0.0) -> Column:
    """Of a query's temporal hint: latest, earliest, around (``lo``) or between (``lo``, ``hi``); otherwise 0."""
    fresh = recency(timestamp, now)
    if kind == "latest":
        return fresh
    if kind == "earliest":
        return 1 - fresh
    if kind == "around":
        d = (timestamp - lo) / DAY
        return F.exp(-0.5 * d * d)
    if kind == "between":
        away = F.greatest(F.lit(lo) - timestamp, timestamp - hi, F.lit(0.0))
        return F.when(away == 0, 1.0).otherwise(F.exp(-away / DAY))
    return F.lit(0.0)


def decayed(importance: Column, accesses: Column, last_access: Column, now: float, rate: float = WEEK_RATE) -> Column:
    return importance * (accesses + 1) * F.exp(-rate * F.greatest(F.lit(now) - last_access, F.lit(0.0)))


def importance(surprise: Column, is_correction: Column, text: Column, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> Column:
    """Surprise, correction and length, weighted, within 0 and 1. A hundred words are of full length."""
    a, b, c = weights
    words = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""))
    total = a * surprise + b * F.when(is_correction, 1.0).otherwise(0.0) + c * F.least(words / 100.0, F.lit(1.0))
    return F.least(F.greatest(total / (a + b + c), F.lit(0.0)), F.lit(1.0))
