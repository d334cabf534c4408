"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, cover_tree, decontaminate, language, lines, packing, quality, secrets, simhash, token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_cover_tree": cover_tree.op1_cover_tree,
        "op2_chat": chat.op2_chat,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_language": language.op4_language,
        "op5_secrets": secrets.op5_secrets,
        "op6_token_files": token_files.op6_token_files,
        "op7_simhash": simhash.op7_simhash,
        "op8_packing": lambda spark, sf_dir: packing.op8_packing(spark, sf_dir),
        "op9_quality": quality.op9_quality,
        "op10_lines": lines.op10_lines,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_cover_tree": cover_tree.OP1_SQL, "op2_chat": chat.OP2_SQL}
