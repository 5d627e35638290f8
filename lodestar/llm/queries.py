"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, clusters, collocation, html, language_model, packing, pii, quality, sentencepiece, simhash, vectors, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.op1_packing,
    "op2_chat_rotation": chat.op2_chat_rotation,
    "op3_exact_top_k": vectors.op3_exact_top_k,
    "op4_nearest": vectors.op4_nearest,
    "op5_pii": pii.op5_pii,
    "op6_simhash": simhash.op6_simhash,
    "op7_sentencepiece": sentencepiece.op7_sentencepiece,
    "op8_html": html.op8_html,
    "op9_quality": quality.op9_quality,
    "op10_warc_audit": warc.op10_warc_audit,
    "op11_language_model": language_model.op11_language_model,
    "op12_clusters": clusters.op12_clusters,
    "op13_collocations": collocation.op13_collocations,
}

#: DuckDB SQL; operators that SQL cannot express are held against brute force in tests/llm.
SQL: dict[str, str] = {
    "op2_chat_rotation": chat.OP2_SQL,
    "op3_exact_top_k": vectors.OP3_SQL,
    "op10_warc_audit": warc.OP10_SQL,
    "op12_clusters": clusters.OP12_SQL,
    "op13_collocations": collocation.OP13_SQL,
}
