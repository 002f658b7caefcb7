"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from quarrylens.llm import (
    byte_bpe, circulant, fingerprints, gated_lm, jaccard, licenses, line_dedup, manifest, packing, repair, token_counts, toxicity, vafile)

_MODULES = {
    "op1_document_fingerprints": fingerprints,
    "op2_license_scan": licenses,
    "op3_best_fit_packing": packing,
    "op4_line_dedup": line_dedup,
    "op5_token_counts": token_counts,
    "op6_toxicity": toxicity,
    "op7_exact_topk": vafile,
    "op8_gated_lm_scoring": gated_lm,
    "op9_byte_bpe": byte_bpe,
    "op10_ngram_jaccard_join": jaccard,
    "op11_merkle_manifest": manifest,
    "op12_circulant_dedup": circulant,
    "op13_conversation_repair": repair,
}

QUERIES = {name: module.query for name, module in _MODULES.items()}
ORACLE = {name: module.ORACLE for name, module in _MODULES.items() if getattr(module, "ORACLE", None)}
