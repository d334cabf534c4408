"""Slow, plain versions of the operators' rules, and awkward inputs."""

import re
from collections import Counter, defaultdict

import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, component_id string, node long"

PROSE = [
    "the quick brown fox jumps over the lazy dog while the sun sets behind old hills",
    "der schnelle braune fuchs springt ueber den faulen hund und schläft dann lange ein",
    "el rápido zorro marrón salta sobre el perro perezoso mientras cae la noche fría",
]


def docs(spark, texts, start=0):
    """Documents with extra columns whose names the operators use themselves."""
    rows = [(i + start, t, "en", "src0", len(t) if t is not None else None, 1, "x", 5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward():
    """Null, empty, blank, short, repeated, long and odd texts."""
    return [None, "", "   \n \n", "one", "one two", PROSE[0], PROSE[0], PROSE[0].upper(), "\n".join(PROSE * 3), "x" * 50_000, ("word " * 20_000).strip(), "é中\U0001f600 \x00 tab\there", PROSE[0] + " again"]


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def signed(data):
    x = xxhash.xxh64_intdigest(data)
    return x - (1 << 64) if x >> 63 else x


def cluster(ms, constant):
    """The number of each line's template, one line after the other."""
    shapes, out = [], []
    for m in ms:
        same = [sum(a == b != "<*>" for a, b in zip(m, t, strict=True)) for t in shapes]
        k = max(range(len(same)), key=lambda i: (same[i], -i), default=None)
        if k is None or same[k] < constant * len(m) - 1e-9:
            shapes.append(list(m))
            out.append(len(shapes) - 1)
        else:
            shapes[k] = [b if a == b else "<*>" for a, b in zip(m, shapes[k], strict=True)]
            out.append(k)
    return out, shapes


def line_dedup(rows, depth=3, least=3, constant=0.7, shard=8192):
    """{doc_id: kept text} for ``rows`` of distinct doc_ids."""
    def mask(line):
        return ["<*>" if re.search("[0-9]", t) else t for t in line.lower().split()]

    where = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            m = tuple(mask(line))
            if len(m) >= least:
                where[m].add(d)
    leaves = defaultdict(list)
    for m in where:
        leaves[(len(m), m[:depth])].append(m)
    template = {}
    for leaf, ms in leaves.items():
        h = {m: signed(" ".join(m).encode()) for m in ms}
        parts = defaultdict(list)
        for m in sorted(ms, key=lambda m: (min(where[m]), h[m])):
            parts[h[m] % -(-len(ms) // shard)].append(m)
        shapes = []
        for p, own in sorted(parts.items()):
            numbers, made = cluster(own, constant)
            for m, k in zip(own, numbers, strict=True):
                template[m] = (p, k)
            shapes += [(min(min(where[m]) for m, n in zip(own, numbers, strict=True) if n == k), p, k, t) for k, t in enumerate(made)]
        to = {(p, k): (p, k) for _, p, k, _ in shapes}
        if len(ms) > shard:
            shapes.sort(key=lambda x: x[:3])
            to = {(p, k): n for (_, p, k, _), n in zip(shapes, cluster([t for *_, t in shapes], constant)[0], strict=True)}
        for m in ms:
            template[m] = (leaf, to[template[m]])
    groups = defaultdict(set)
    for m, t in template.items():
        groups[t] |= where[m]
    out = {}
    for d, text in rows:
        if text is None:
            out[d] = None
            continue
        kept = []
        for line in text.split("\n"):
            m = tuple(mask(line))
            if len(m) >= least and len(groups[template[m]]) > 1 and min(groups[template[m]]) != d:
                continue
            kept.append(line)
        out[d] = "\n".join(kept)
    return out


def edit_within(item, text):
    """Least edits of ``item`` to any substring of ``text``."""
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        cur = [i]
        for j, d in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != d)))
        prev = cur
    return min(prev)
