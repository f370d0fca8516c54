"""The queries of this folder by name, and the SQL that checks them."""

from tessella.llm import ann, line_dedup, packing, quality_crf, quality_rules, sentencepiece_nbest, simhash, sort_means, spelling, substring_dedup, topk_search, toxicity, url_filter

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_sentencepiece": sentencepiece_nbest.op2_sentencepiece,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_quality": quality_crf.op5_quality,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_ann": ann.op7_ann,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_simhash": simhash.op10_simhash,
    "op11_spelling": spelling.op11_spelling,
    "op12_sort_means": sort_means.op12_sort_means,
    "op13_topk": topk_search.op13_topk,
}
SQL = {
    "op3_substring_dedup": substring_dedup.OP3_SQL,
    "op4_url_filter": url_filter.op4_sql(),
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op11_spelling": spelling.OP11_SQL,
    "op12_sort_means": sort_means.op12_sql(),
    "op13_topk": topk_search.OP13_SQL,
}
