"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm import chat, decontaminate, imatch, linededup, neardup, packing, quality, sharding, tokencount, toxicity
from quillspan.llm.common import prepare


def _prepared(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {
        "op1_line_dedup": linededup.op1_line_dedup,
        "op1_line_dedup_documents": linededup.op1_line_dedup_documents,
        "op2_jaccard": neardup.op2_jaccard,
        "op3_decontamination": decontaminate.op3_decontamination,
        "op4_token_counts": tokencount.op4_token_counts,
        "op5_quality": quality.op5_quality,
        "op6_imatch": imatch.op6_imatch,
        "op7_chat": chat.op7_chat,
        "op8_packing": packing.op8_packing,
        "op9_sharding": sharding.op9_sharding,
        "op10_toxicity": toxicity.op10_toxicity,
    }
    return {name: _prepared(query) for name, query in own.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": linededup.ORACLE,
        "op1_line_dedup_documents": linededup.ORACLE_DOCUMENTS,
        "op2_jaccard": neardup.ORACLE,
        "op3_decontamination": decontaminate.ORACLE,
        "op7_chat": chat.ORACLE,
        "op9_sharding": sharding.ORACLE,
    }
