"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, chat, html_extract, langid, lm, packing, quality, quality_sql, simhash, topk, toxicity


def queries() -> dict:
    return {
        "op1_bpe_round_trip": bpe.op1_bpe_round_trip,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_robust_outliers": quality.op4_robust_outliers,
        "op5_html_main_text": html_extract.op5_html_main_text,
        "op6_exact_top_k": topk.op6_exact_top_k,
        "op7_stupid_backoff": lm.op7_stupid_backoff,
        "op8_chat_formatting": chat.op8_chat_formatting,
        "op9_language_id": langid.op9_language_id,
        "op10_simhash_vptree": simhash.op10_simhash_vptree,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_robust_outliers": quality_sql.sql(), "op6_exact_top_k": topk.OP6_SQL, "op7_stupid_backoff": lm.OP7_SQL, "op8_chat_formatting": chat.OP8_SQL}
