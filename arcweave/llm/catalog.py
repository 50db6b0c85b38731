"""Queries of this subpackage over the driver's tables, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from arcweave.functions.shipping import shipped
from arcweave.llm import chat, collocations, decontaminate, exact_dedup, html_text, line_dedup, mixing, near_dedup, resampling, secrets, token_store, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_near_dedup": near_dedup.op2_near_dedup,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_url_filter": urls.op4_url_filter,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_chat_format": chat.op6_chat_format,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_secret_scan": secrets.op9_secret_scan,
        "op10_token_output": token_store.op10_token_output,
        "op11_resample": resampling.op11_resample,
        "op12_collocations": collocations.op12_collocations,
        "op13_html_text": html_text.op13_html_text,
        "pipeline": corpus_pipeline.run,
    }
    return {name: shipped(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": mixing.OP1_SQL,
        "op2_near_dedup": near_dedup.OP2_SQL,
        "op3_decontaminate": decontaminate.OP3_SQL,
        "op6_chat_format": chat.OP6_SQL,
        "op7_exact_dedup": exact_dedup.OP7_SQL,
        "op8_line_dedup": line_dedup.OP8_SQL,
        "op9_secret_scan": secrets.OP9_SQL,
        "op11_resample": resampling.OP11_SQL,
        "op12_collocations": collocations.OP12_SQL,
        "op13_html_text": html_text.OP13_SQL,
    }
