"""Secret scans with multipart credential linking, in DataFrame functions only.

Base findings stand alone: assigned secrets, access identifiers, long hexadecimal strings. Weak candidates (account names,
other key identifiers, random-looking strings, endpoints) mean nothing alone. They are laid on the
text as intervals and joined within a scope: a candidate is reported only where what complements it lies near.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import starts
from .shared import materialize

#: Kinds in the order in which spans that start together are listed. The first three are the base.
KINDS = ["assign", "access", "hex", "identifier", "secret", "endpoint"]
SCOPE = 256

ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: As the drop of short matches leaves it: what is too short as a whole run can't hold a long enough one.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
IDENTIFIER = r"(?<![A-Za-z0-9_])(?:(?:ASIA|AIDA|AROA|AGPA|ANPA)[A-Z0-9]{12,}|(?i:user|user_?name|login|account|client_?id|key_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.@-]{3,})"
RANDOM = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[A-Z])(?=[A-Za-z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{24,}"
ENDPOINT = r"(?<![A-Za-z0-9])(?:https?|ftp|sftp|ssh|postgres|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]{3,}|(?<![A-Za-z0-9_])(?i:host|endpoint|url|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.:/-]{4,}"


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _cuts(text: Column, pattern: str, found: Column) -> Column:
    """What splitting leaves between the matches ``found``, and these: ``array<struct<gap, hit>>``, gap a length; the last has no hit."""
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    return F.when(F.size(found) > 0, F.arrays_zip(between.alias("gap"), found.alias("hit")))


def _spans(cuts: Column, at: Column) -> Column:
    """``array<struct<start, end, hit>>``, in code points, of the matches in ``cuts`` that begin at the running sums ``at``."""
    each = F.zip_with(cuts, at, lambda c, s: F.struct((s + c["gap"]).alias("start"), (s + c["gap"] + F.length(c["hit"])).alias("end"), c["hit"].alias("hit")))
    return F.coalesce(F.filter(each, lambda x: x["hit"].isNotNull()), F.array().cast("array<struct<start:int,end:int,hit:string>>"))


def find_parts(docs: DataFrame, *more: Column) -> DataFrame:
    """``(doc_id, text_key, *more, parts)``: parts are ``array<struct<start, kind, end>>`` of all kinds, by place.

    ``kind`` counts in KINDS. Matches are leftmost and don't overlap within a kind; weak ones that overlap a base one are left out.
    """
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    patterns = [ASSIGN, ACCESS, HEX, IDENTIFIER, RANDOM, ENDPOINT]
    hits = raw.withColumns({f"m{k}": _found(F.col("t"), p) for k, p in enumerate(patterns)})
    some = F.greatest(*[F.size(f"m{k}") for k in range(len(patterns))]) > 0
    cuts = hits.withColumns({f"c{k}": _cuts(F.col("t"), p, F.col(f"m{k}")) for k, p in enumerate(patterns)} | {"text_key": F.when(some, F.md5("t"))})
    sized = cuts.withColumns({f"n{k}": F.transform(f"c{k}", lambda c: c["gap"] + F.coalesce(F.length(c["hit"]), F.lit(0))) for k in range(len(patterns))})
    spans = sized.withColumns({f"s{k}": _spans(F.col(f"c{k}"), starts(F.col(f"n{k}"))) for k in range(len(patterns))})
    strong = F.filter("s0", lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= 8)

    def own(spans_: Column, kind: int) -> Column:
        return F.transform(spans_, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    base = spans.withColumn("base", F.array_sort(F.concat(own(strong, 0), own(F.col("s1"), 1), own(F.col("s2"), 2))))
    weak = base.withColumn("weak", F.concat(*[own(F.col(f"s{k}"), k) for k in (3, 4, 5)]))
    return weak.select("doc_id", *[x for x in raw.columns if x not in ("doc_id", "t")], "text_key", "base", "weak")


def link(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``(doc_id, text_key, linked)``: weak candidates that complementary parts stand near, as arrays of spans by place.

    An identifier needs a secret (base or weak), a weak secret needs an identifier, an endpoint needs both, at most ``scope``
    characters from border to border. The nearest part of each role before and after is carried along the text by
    windows over the document's parts, so the work is that of sorting them, and no pairs are made. A candidate that overlaps
    a base span is part of it and is not reported.
    """
    some = parts.where(F.size("weak") > 0).select("doc_id", "text_key", F.explode(F.concat("base", "weak")).alias("p"))
    p = some.select("doc_id", "text_key", "p.*").distinct()
    # roles: 0 identifiers, 1 secrets, 2 base spans
    own, past = Window.partitionBy("doc_id", "text_key"), (Window.unboundedPreceding, -1)
    before = own.orderBy("start", "end", "kind").rowsBetween(*past)
    after = own.orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(*past)  # a frame up to the end would be summed up anew for each row
    roles = {"identifier": F.col("kind").isin(1, 3), "secret": F.col("kind").isin(0, 2, 4), "base": F.col("kind") < 3}
    near = p.withColumns({f"{name}_before": F.max(F.when(is_role, F.col("end"))).over(before) for name, is_role in roles.items()})
    near = near.withColumns({f"{name}_after": F.min(F.when(is_role, F.col("start"))).over(after) for name, is_role in roles.items()})

    def close(name: str) -> Column:
        return F.coalesce(F.col("start") - F.col(f"{name}_before") <= scope, F.lit(False)) | F.coalesce(F.col(f"{name}_after") - F.col("end") <= scope, F.lit(False))

    apart = ~F.coalesce(F.col("base_before") > F.col("start"), F.lit(False)) & ~F.coalesce(F.col("base_after") < F.col("end"), F.lit(False))
    needs = F.when(F.col("kind") == 3, close("secret")).when(F.col("kind") == 4, close("identifier")).when(F.col("kind") == 5, close("identifier") & close("secret"))
    kept = near.where((F.col("kind") >= 3) & apart & needs)
    return kept.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("linked"))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``(doc_id, base, linked)`` for every row of ``docs(doc_id, text)``: arrays of ``struct<start, kind, end>`` by place.

    Null text is empty and empty text holds nothing. Repeated rows get the same result each. Rows without a doc_id keep their
    base spans, and link among parts of the same text.
    """
    parts = materialize(find_parts(docs), "parts")
    linked = link(parts, scope).withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"})
    both = parts.join(linked, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")), "left")
    return both.select("doc_id", "base", F.coalesce("linked", F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("linked"))


def as_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import table

    found = scan(table(spark, sf_dir, "documents"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.array_sort(F.concat("base", "linked"))).alias("spans"))
