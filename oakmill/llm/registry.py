"""The queries opN_<name> of this subpackage, and SQL for those that SQL can express."""

from oakmill.llm import bpe, exact_dedup, near_dedup, packing, quotes, substring_dedup, token_counts, topk, toxicity, warc

QUERIES = {
    "op1_top_k": topk.op1_top_k,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_warc_fixity": warc.op6_warc_fixity,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_quotation_linking": quotes.op8_quotation_linking,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

ORACLE_SQL = {
    "op1_top_k": topk.SQL,
    "op4_substring_dedup": substring_dedup.SQL,
    "op6_warc_fixity": warc.SQL,
    "op8_quotation_linking": quotes.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
}
