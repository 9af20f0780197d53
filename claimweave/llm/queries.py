"""The queries of the operators, by their registered names, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimweave.llm import ann, decontaminate, language_id, minhash, mixing, quality, toxicity, url_reputation, warc, wrapper

_MODULES = {
    "op1_toxicity": toxicity,
    "op2_wrapper": wrapper,
    "op3_ann": ann,
    "op4_warc": warc,
    "op5_language_id": language_id,
    "op6_quality": quality,
    "op7_minhash": minhash,
    "op8_decontaminate": decontaminate,
    "op9_mixing": mixing,
    "op10_url_reputation": url_reputation,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in _MODULES.items() if hasattr(module, "ORACLE_SQL")}
