"""Entities in text and expansions of queries. Rules are procedural, so they run in Arrow batches, a text at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORGANISATION = frozenset("association co corp foundation group inc institute labs llc ltd solutions systems technologies".split())
PLACE = frozenset("avenue bay boulevard city county island lake mountain park province river state street valley".split())
STOP = frozenset("A An And Are At But For He Her His I In Is It Its My Of On Or Our She That The These They This Those To Was We Were".split())
TECHNOLOGY = sorted(
    """AWS Actix Angular Ansible Apache Axum Azure C C# C++ CUDA Cassandra Clojure CockroachDB Dart Django Docker DynamoDB Elasticsearch Elixir Erlang Express FastAPI Flask GCP Git Go Grafana GraphQL HDF5 Haskell Helm InfluxDB JWT Java JavaScript Julia Kafka Kotlin Kubernetes Laravel Linux Lua MSSQL MariaDB MongoDB MySQL Neo4j Next.js Nginx Nuxt OAuth OpenGL Oracle PHP Perl PostgreSQL Prometheus Python R REST RabbitMQ Rails React Redis Remix Rocket Ruby Rust SQLite Scala Spring Svelte Swift Terraform TypeScript Vue Vulkan WASM Warp WebAssembly WebSocket Windows Zig gRPC macOS""".split(),
    key=len,
    reverse=True,
)
_RELATIVE = sorted([f"{a} {b}" for a in ("last", "next", "this") for b in ("week", "month", "year")] + ["recently", "soon", "today", "tomorrow", "yesterday"], key=len, reverse=True)
_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
_DATE = [
    re.compile(rf"(?<![a-z])(?:{'|'.join(_RELATIVE)})(?![a-z])", re.I),
    re.compile(r"(?<![A-Za-z0-9])[0-9]{4}([-/])[0-9]{2}\1[0-9]{2}(?![A-Za-z0-9])"),
    re.compile(rf"(?<![a-z])(?:{_MONTHS}|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)(?![a-z])\s*[0-9]+(?:st|nd|rd|th)?(?:\s*,\s*[0-9]{{4}}(?![0-9]))?", re.I),
]
_TECH = re.compile(r"(?<![A-Za-z0-9_])(?:" + "|".join(map(re.escape, TECHNOLOGY)) + r")(?![A-Za-z0-9_-])")
_HUMPED = re.compile(r"[A-Z][A-Za-z0-9_]*")
_KEBAB = re.compile(r"[a-z][A-Za-z0-9-]*")
_WORD = re.compile(r"[A-Za-z][A-Za-z0-9']*")


def entities(text: str, custom: list[tuple[str, str, float]] = (), least: float = 0.5) -> list[tuple[str, str, int, int, float]]:
    """``(text, type, start, end, confidence)`` with byte places, without overlaps: the earlier wins, then the surer."""
    found: list[tuple[int, int, str, str, float]] = []
    for p in _DATE:
        found += [(m.start(), m.end(), m[0], "Date", 0.95) for m in p.finditer(text)]
    found += [(m.start(), m.end(), m[0], "Technology", 0.9) for m in _TECH.finditer(text)]
    for m in _HUMPED.finditer(text):
        w = m[0]
        if (m.start() == 0 or not text[m.start() - 1].isascii() or not text[m.start() - 1].isupper()) and len(w) >= 4 and any(c.isupper() for c in w[1:]) and sum(c.islower() for c in w) >= 2:
            found.append((m.start(), m.end(), w, "Project", 0.7))
    for m in _KEBAB.finditer(text):
        if "-" in m[0] and len(m[0]) >= 4 and all(m[0].split("-")):
            found.append((m.start(), m.end(), m[0], "Project", 0.7))
    found += _capitalised(text)
    for literal, kind, sure in custom:
        at = text.find(literal)
        while literal and at >= 0:
            found.append((at, at + len(literal), literal, kind, sure))
            at = text.find(literal, at + 1)
    out: list[tuple[str, str, int, int, float]] = []
    end = -1
    plain = text.isascii()
    for s, e, t, kind, sure in sorted((f for f in found if f[4] >= least), key=lambda f: (f[0], -f[4])):
        if s >= end:
            a = s if plain else len(text[:s].encode())
            out.append((t, kind, a, a + len(t.encode()), sure))
            end = e
    return out


def _capitalised(text: str) -> list[tuple[int, int, str, str, float]]:
    """Runs of up to three capitalised words, none at the start of a sentence."""
    starts, fresh = set(), True
    for i, c in enumerate(text):
        if fresh and c.isalpha():
            starts.add(i)
            fresh = False
        if c in ".!?\n":
            fresh = True
    words = list(_WORD.finditer(text))
    good = lambda m: m[0][0].isupper() and m[0] not in STOP
    out, i = [], 0
    while i < len(words):
        if words[i].start() in starts or not good(words[i]):
            i += 1
            continue
        j = i + 1
        while j < len(words) and j - i < 3 and good(words[j]):
            j += 1
        last = words[j - 1][0].lower()
        kind = "Organization" if last in ORGANISATION else "Location" if last in PLACE else "Person" if j - i == 2 else "Organization"
        a, b = words[i].start(), words[j - 1].end()
        out.append((a, b, text[a:b], kind, 0.6))
        i = j
    return out


def extract(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text, type, start, end, confidence)`` for every row; null text holds nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, *e) for i, t in zip(b[id_col], b[text_col], strict=True) if t for e in entities(t)]
            if out:
                yield pd.DataFrame(out, columns=["id", "text", "type", "start", "end", "confidence"])

    return rows.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInPandas(run, "id long, text string, type string, start int, end int, confidence double")


def distinct_entities(found: DataFrame) -> DataFrame:
    """One row for each text and type, whatever the case: the first by id and place."""
    key = F.struct("id", "start")
    return found.groupBy(F.lower("text").alias("key"), "type").agg(F.min_by("text", key).alias("text"), F.count("*").alias("n"))


SYNONYMS = [g.split("|") for g in ("fast|performant|quick|rapid|speedy", "alter|change|edit|modify|update", "destroy|delete|drop|erase|remove", "bug|defect|error|issue|problem", "build|construct|create|implement|make", "memory|recall|recollection|remember", "find|look for|query|retrieve|search")]
ACRONYMS = dict(
    AI="Artificial Intelligence", API="Application Programming Interface", CD="Continuous Deployment", CI="Continuous Integration", CLI="Command Line Interface", CPU="Central Processing Unit", DB="database", GPU="Graphics Processing Unit",
    GUI="Graphical User Interface", HTTP="Hypertext Transfer Protocol", LLM="Large Language Model", ML="Machine Learning", NoSQL="Not only SQL", ORM="Object Relational Mapper", OS="Operating System", PR="Pull Request", SDK="Software Development Kit", SQL="Structured Query Language", database="DB",
) | {"CI/CD": "Continuous Integration / Continuous Deployment"}
TEMPORAL = {
    "last month": "recent|last few weeks|previously", "last week": "this week|recent|recently", "next month": "upcoming|soon|in the future",
    "recently": "last few days|this week|today", "this week": "recent|last few days|lately", "today": "now|current|this moment", "yesterday": "today|recent|last few days",
}
#: Endings in the order in which they are tried, and what may stand for each.
ENDINGS = [(e, o.split("/")) for e, o in (x.split(">") for x in "ing>ed/s/ion ed>ing/s ly> tion>te ations>ate ies>y/ied s>".split(" "))]


def _once(text: str, old: str, new: str) -> str:
    at = text.lower().find(old.lower())
    return text if at < 0 else text[:at] + new + text[at + len(old) :]


def _stands(text: str, phrase: str) -> bool:
    """Whether the first place of a phrase has no letter or digit at either side."""
    low = text.lower()
    at = low.find(phrase)
    side = lambda c: not (c.isascii() and c.isalnum())
    return at >= 0 and (at == 0 or side(low[at - 1])) and (at + len(phrase) >= len(low) or side(low[at + len(phrase)]))


def expand(query: str, most: int = 5, extra: list[tuple[str, str, float]] = ()) -> list[tuple[str, str, float]]:
    """``(text, kind, weight)``: rewordings of a query, the weightiest first, each text once whatever its case."""
    out: list[tuple[str, str, float]] = []
    for group in SYNONYMS:
        for term in group:
            if _stands(query, term):
                out += [(_once(query, term, o), "synonym", 0.7) for o in group if o != term]
    out += [(_once(query, a, b), "acronym", 0.8) for a, b in ACRONYMS.items()]
    for phrase, others in TEMPORAL.items():
        if _stands(query, phrase):
            out += [(_once(query, phrase, o), "temporal", 0.6) for o in others.split("|")]
    for word in re.findall(r"[^\W_]+", query):
        for ending, others in ENDINGS:
            low = word.lower()
            if len(low) > len(ending) + 2 and low.endswith(ending):
                changed = [_once(query, word, low[: -len(ending)] + o) for o in others if len(low) - len(ending) + len(o) >= 2]
                changed = [c for c in changed if c != query]
                if changed:
                    out.append((changed[0], "morphological", 0.5))
                    break
    seen = {query.lower()}
    unique = []
    for t in sorted([*out], key=lambda x: -x[2])[:] if not extra else sorted([*_first(out, seen, most), *extra], key=lambda x: -x[2]):
        if t[0].lower() not in seen:
            seen.add(t[0].lower())
            unique.append(t)
    return unique[:most]


def _first(out: list[tuple[str, str, float]], seen: set[str], most: int) -> list[tuple[str, str, float]]:
    have, kept = set(seen), []
    for t in sorted(out, key=lambda x: -x[2]):
        if t[0].lower() not in have:
            have.add(t[0].lower())
            kept.append(t)
    return kept[:most]


def expand_queries(queries: DataFrame, most: int = 5) -> DataFrame:
    """``(query_id, rank, text, kind, weight)`` of ``queries(query_id, text)``, and of what graph neighbours add where there is a column ``extra``."""
    graph = "extra" in queries.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            extras = b["extra"] if graph else [()] * len(b)
            for i, t, x in zip(b["query_id"], b["text"], extras, strict=True):
                more = [(e, "knowledge_graph", 0.85) for e in x] if x is not None else []
                rows += [(i, k + 1, *e) for k, e in enumerate(expand(t, most, more))]
            if rows:
                yield pd.DataFrame(rows, columns=["query_id", "rank", "text", "kind", "weight"])

    return queries.mapInPandas(run, "query_id long, rank int, text string, kind string, weight double")
