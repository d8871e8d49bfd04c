"""The subpackage's registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from . import fingerprints, line_dedup, lm_scoring, matroska, mixing, near_dedup, packing, pieces, ranking, token_alignment, token_counts, token_output, toxicity

QUERIES = {
    "op7_token_counts": token_counts.op7_token_counts,
    "op10_toxicity": toxicity.op10_toxicity,
    "op6_lm_scoring": lm_scoring.op6_lm_scoring,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op9_fingerprints": fingerprints.op9_fingerprints,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op1_mixing": mixing.op1_mixing,
    "op4_media_columns": matroska.op4_media_columns,
    "op2_token_output": token_output.op2_token_output,
    "op11_token_alignment": token_alignment.op11_token_alignment,
    "op12_packing": packing.op12_packing,
    "op13_ranking": ranking.op13_ranking,
}

ORACLE_SQL: dict[str, str] = {"op13_ranking": ranking.ORACLE_SQL}
