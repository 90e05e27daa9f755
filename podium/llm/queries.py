"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from podium.llm import (
    bpe,
    centroids,
    decontaminate,
    language_crf,
    lexical_search,
    line_quality,
    near_dedup,
    quality_fm,
    secret_forest,
    substring_dedup,
    suffix_dedup,
    token_files,
    toxicity,
)

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_secret_forest": secret_forest.op3_secret_forest,
    "op4_line_quality": line_quality.op4_line_quality,
    "op5_bpe": bpe.op5_bpe,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_quality_fm": quality_fm.op7_quality_fm,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_language_crf": language_crf.op9_language_crf,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_centroids": centroids.op11_centroids,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_token_files": token_files.op13_token_files,
}
SQL = {
    "op2_decontaminate": decontaminate.SQL,
    "op4_line_quality": line_quality.SQL,
    "op6_near_dedup": near_dedup.SQL,
    "op8_substring_dedup": substring_dedup.SQL,
    "op10_suffix_dedup": suffix_dedup.SQL,
    "op11_centroids": centroids.SQL,
    "op12_lexical_search": lexical_search.SQL,
}
