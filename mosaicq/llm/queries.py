"""The corpus operators' queries, by the names under which __spark_entry__ registers them, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mosaicq.llm import ann, decontaminate, lines, lm, mixing, paragraphs, quality, repeats, simhash, token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_output": token_files.op1,
        "op2_decontamination": decontaminate.op2,
        "op3_simhash": simhash.op3,
        "op4_line_dedup": lines.op4,
        "op5_quality": quality.op5,
        "op6_lm_score": lm.op6,
        "op7_repeats": repeats.op7,
        "op8_mixing": mixing.op8,
        "op9_neighbours": ann.op9,
        "op10_paragraphs": paragraphs.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_repeats": repeats.ORACLE_SQL, "op8_mixing": mixing.ORACLE_SQL}
