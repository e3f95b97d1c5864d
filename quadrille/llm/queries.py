"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from quadrille.llm import decontaminate, language, lines, near_dup, packing, quality, substrings, topk, toxicity, url_filter

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_quality_classifier": quality.query,
    "op3_minhash_near_dup": near_dup.query,
    "op4_language_id": language.query,
    "op5_line_dedup": lines.query,
    "op6_exact_top_k": topk.query,
    "op7_decontaminate": decontaminate.query,
    "op8_toxicity": toxicity.query,
    "op9_suffix_dedup": substrings.query,
    "op10_url_filter": url_filter.query,
}

ORACLES = {
    "op3_minhash_near_dup": near_dup.ORACLE,
    "op5_line_dedup": lines.ORACLE,
    "op6_exact_top_k": topk.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
}
