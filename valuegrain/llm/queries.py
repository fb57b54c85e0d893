"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import backoff_lm, exact_dedup, html_lstm, language_gru, line_crf, mixing, near_dedup, packing, quality_nbsvm, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_crf": line_crf.op1_line_crf,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_html_lstm": html_lstm.op3_html_lstm,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_mixing": mixing.op5_mixing,
    "op6_language_gru": language_gru.op6_language_gru,
    "op7_quality_nbsvm": quality_nbsvm.op7_quality_nbsvm,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_backoff_lm": backoff_lm.op9_backoff_lm,
    "op10_packing": packing.op10_packing,
}

ORACLES: dict[str, str] = {
    "op2_near_dedup": near_dedup.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op9_backoff_lm": backoff_lm.ORACLE,
}
