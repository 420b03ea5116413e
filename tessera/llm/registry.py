"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import exact, media, mixing, negatives, neighbours, packing, repeats, resampling, rollups, simhash, toxicity, urls, wrappers

QUERIES = {
    "op1_simhash_dedup": simhash.op1_simhash_dedup,
    "op2_media_columns": media.op2_media_columns,
    "op3_mixing": mixing.op3_mixing,
    "op4_suffix_dedup": repeats.op4_suffix_dedup,
    "op5_html_extraction": wrappers.op5_html_extraction,
    "op6_embedding_dedup": neighbours.op6_embedding_dedup,
    "op7_packing": packing.op7_packing,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_token_counts": rollups.op9_token_counts,
    "op10_url_filters": urls.op10_url_filters,
    "op11_exact_dedup": exact.op11_exact_dedup,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_hard_negatives": negatives.op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op3_mixing": mixing.OP3_SQL,
    "op9_token_counts": rollups.OP9_SQL,
    "op10_url_filters": urls.OP10_SQL,
    "op11_exact_dedup": exact.OP11_SQL,
    "op13_hard_negatives": negatives.OP13_SQL,
}
