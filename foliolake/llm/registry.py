"""The corpus queries and their SQL."""

from __future__ import annotations

from . import audit, decontamination, fuzzy_lines, grace, mixing, negatives, ngram_join, personal_data, perspectives, quality, sharding, spans, suffixes

QUERIES = {
    "op1_perspective_rotation": perspectives.op1_perspective_rotation,
    "op2_sentence_spans": spans.op2_sentence_spans,
    "op3_crf_personal_data": personal_data.op3_crf_personal_data,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_extendible_shards": sharding.op5_extendible_shards,
    "op6_latent_leaks": decontamination.op6_latent_leaks,
    "op7_fuzzy_lines": fuzzy_lines.op7_fuzzy_lines,
    "op8_robust_quality": quality.op8_robust_quality,
    "op9_ngram_jaccard": ngram_join.op9_ngram_jaccard,
    "op10_suffix_lpf": suffixes.op10_suffix_lpf,
    "op11_vector_negatives": negatives.op11_vector_negatives,
    "op12_filter_audit": audit.op12_filter_audit,
    "op13_grace_dedup": grace.op13_grace_dedup,
}

ORACLES = {
    "op1_perspective_rotation": perspectives.ORACLE,
    "op4_mix_sources": mixing.ORACLE,
    "op5_extendible_shards": sharding.ORACLE,
    "op9_ngram_jaccard": ngram_join.ORACLE,
    "op11_vector_negatives": negatives.ORACLE,
    "op12_filter_audit": audit.ORACLE,
    "op13_grace_dedup": grace.ORACLE,
}
