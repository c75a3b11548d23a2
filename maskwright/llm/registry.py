"""The queries of this subpackage, by name, and the SQL for those that SQL can express."""

from maskwright.llm import exact_dedup, line_dedup, mixing, ngram_join, quality, secret_scan, sentence_pieces, suffix_dedup, topk_search, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_secret_scan": secret_scan.query,
    "op3_sentence_pieces": sentence_pieces.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_toxicity": toxicity.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_quality": quality.query,
    "op8_ngram_join": ngram_join.query,
    "op9_mixing": mixing.query,
    "op10_topk_search": topk_search.query,
}
ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op10_topk_search": topk_search.ORACLE,
}
