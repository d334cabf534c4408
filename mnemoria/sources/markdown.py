"""Markdown as sections, and records as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sections(docs: DataFrame, min_level: int = 1, id_col: str = "path", text_col: str = "content") -> DataFrame:
    """``(path, nth, heading, content, line_start, line_end, level)``: a section for each ATX heading of at least ``min_level`` marks.

    What stands before the first one has level 0 and goes if it is blank. Line numbers count from 0; line breaks at a section's end go.
    """
    lines = docs.select(F.col(id_col).alias("path"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n", -1)).alias("n", "line"))
    marks = F.length(F.regexp_extract("line", r"^(#{1,6})(?:\s|$)", 1))
    lines = lines.withColumn("level", F.when(marks >= min_level, marks).otherwise(0))
    w = Window.partitionBy("path").orderBy("n")
    lines = lines.withColumn("nth", F.sum((F.col("level") > 0).cast("int")).over(w))
    first = F.min_by(F.struct("line", "level"), "n")
    body = F.array_sort(F.collect_list(F.struct("n", "line", "level")))
    g = lines.groupBy("path", "nth").agg(first.alias("f"), body.alias("b"), F.min("n").alias("line_start"), F.max("n").alias("line_end"))
    text = F.array_join(F.transform(F.filter("b", lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    heading = F.when(F.col("f.level") > 0, F.trim(F.regexp_replace(F.col("f.line"), r"^#+\s*", "")))
    out = g.select("path", "nth", heading.alias("heading"), F.regexp_replace(text, r"\n+$", "").alias("content"), "line_start", "line_end", F.col("f.level").alias("level"))
    return out.where((F.col("level") > 0) | (F.trim("content") != ""))


def export(records: DataFrame) -> DataFrame:
    """``(session_id, markdown)`` of ``records(session_id, mem_id, source_channel, chunk)``: a heading of level 2 and a comment of metadata for each."""
    one = F.concat(F.lit("## "), F.col("source_channel"), F.lit("\n<!-- id: "), F.col("mem_id").cast("string"), F.lit(" -->\n"), F.col("chunk"), F.lit("\n"))
    return records.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("mem_id", one.alias("md")))), lambda x: x["md"]), "\n").alias("markdown"))


def lines_of(records: DataFrame, path: str, start: int, n: int) -> DataFrame:
    """Lines ``start`` to ``start + n`` of what was stored under a path or under a heading of it; one row."""
    own = records.where((F.col("source_channel") == path) | F.startswith("source_channel", F.lit(path + "::")))
    whole = own.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("mem_id", "chunk"))), lambda x: x["chunk"]), "\n").alias("all"))
    return whole.select(F.array_join(F.slice(F.split("all", "\n"), start + 1, n), "\n").alias("text"))
