"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from mnemolake.llm import codebooks, exactdup, langid, licenses, linededup, mixing, neardup, packing, quality, resample, tokenfiles, topk, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_near_dedup": neardup.op2_near_dedup,
    "op3_language_id": langid.op3_language_id,
    "op4_mix": mixing.op4_mix,
    "op5_exact_dedup": exactdup.op5_exact_dedup,
    "op6_quality": quality.op6_quality,
    "op7_packing": packing.op7_packing,
    "op8_top_k": topk.op8_top_k,
    "op9_licenses": licenses.op9_licenses,
    "op10_line_dedup": linededup.op10_line_dedup,
    "op11_token_files": tokenfiles.op11_token_files,
    "op12_vector_codes": codebooks.op12_vector_codes,
    "op13_resample": resample.op13_resample,
}
ORACLES = {
    "op4_mix": mixing.OP4_SQL,
    "op5_exact_dedup": exactdup.OP5_SQL,
    "op8_top_k": topk.OP8_SQL,
    "op9_licenses": licenses.OP9_SQL,
    "op12_vector_codes": codebooks.OP12_SQL,
    "op13_resample": resample.OP13_SQL,
}
