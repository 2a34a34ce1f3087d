"""The corpus operators' queries over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import op10_bpe
from tidemark.llm.language import op7_language
from tidemark.llm.licenses import op2_license_scan, op2_sql
from tidemark.llm.minhash import op6_minhash
from tidemark.llm.mixing import op5_mixing
from tidemark.llm.neighbours import OP11_SQL, op11_neighbours
from tidemark.llm.periods import op13_periods
from tidemark.llm.resampling import op12_resampling
from tidemark.llm.suffixes import op9_suffix_dedup
from tidemark.llm.topk import OP3_SQL, op3_topk
from tidemark.llm.urls import op8_sql, op8_url_filter
from tidemark.llm.vectors import OP4_SQL, op4_vector_dedup
from tidemark.llm.warc import OP1_SQL, op1_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_warc, op2_license_scan, op3_topk, op4_vector_dedup, op5_mixing, op6_minhash, op7_language, op8_url_filter, op9_suffix_dedup, op10_bpe, op11_neighbours, op12_resampling, op13_periods)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op2_license_scan": op2_sql(), "op3_topk": OP3_SQL, "op4_vector_dedup": OP4_SQL, "op8_url_filter": op8_sql(), "op11_neighbours": OP11_SQL}
