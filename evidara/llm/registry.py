"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from evidara.llm import conversation_repair, embedding_join, html_text, langid, license_scan, mixing, neighbour_quality, ngram_join, packing, quality, sharding, substring_dedup, token_alignment
from evidara.llm.session import table


def op7_ngram_jaccard(spark, sf_dir):
    return ngram_join.similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def queries() -> dict:
    return {
        "op1_license_scan": license_scan.op1_license_scan,
        "op2_line_quality": quality.op2_line_quality,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_html_text": html_text.op4_html_text,
        "op5_packing": packing.op5_packing,
        "op6_mixing": mixing.op6_mixing,
        "op7_ngram_jaccard": op7_ngram_jaccard,
        "op8_sharding": sharding.op8_sharding,
        "op9_language_id": langid.op9_language_id,
        "op10_embedding_join": embedding_join.op10_embedding_join,
        "op11_conversation_repair": conversation_repair.op11_conversation_repair,
        "op12_token_alignment": token_alignment.op12_token_alignment,
        "op13_neighbour_quality": neighbour_quality.op13_neighbour_quality,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.OP1_SQL,
        "op2_line_quality": quality.OP2_SQL,
        "op3_substring_dedup": substring_dedup.OP3_SQL,
        "op6_mixing": mixing.OP6_SQL,
    }
