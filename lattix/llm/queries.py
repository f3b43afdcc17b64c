"""The registered queries of the operators, one for each, over whole tables with production parameters."""

from __future__ import annotations

from . import decontamination, html, language_model, lexical, packing, quality, sharding, simhash, substrings, token_counts, token_files, toxicity, whitening

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_language_model": language_model.op3_language_model,
    "op4_packing": packing.op4_packing,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_quality": quality.op6_quality,
    "op7_html": html.op7_html,
    "op8_token_files": token_files.op8_token_files,
    "op9_substrings": substrings.op9_substrings,
    "op10_sharding": sharding.op10_sharding,
    "op11_whitening": whitening.op11_whitening,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_ranked_search": lexical.op13_ranked_search,
}
#: DuckDB SQL for those that SQL can express.
ORACLES = {"op6_quality": quality.ORACLE, "op13_ranked_search": lexical.ORACLE}
