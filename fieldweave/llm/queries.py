"""The numbered queries and their SQL."""

from __future__ import annotations

from fieldweave.llm import conversation_trie, html_extraction, jaccard_join, kmeans_tree, language_id, lexical_search, line_dedup, packing, preference_format, quality_rules, sharding, substring_dedup, trie_bpe

QUERIES = {
    "op1_best_fit": packing.op1_best_fit,
    "op2_host_suffix_array": html_extraction.op2_host_suffix_array,
    "op3_preference": preference_format.op3_preference,
    "op4_sampled_splitters": sharding.op4_sampled_splitters,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_hyperdimensional": language_id.op6_hyperdimensional,
    "op7_host_rules": quality_rules.op7_host_rules,
    "op8_paragraph_banding": substring_dedup.op8_paragraph_banding,
    "op9_kmeans_tree": kmeans_tree.op9_kmeans_tree,
    "op10_trie_bpe": trie_bpe.op10_trie_bpe,
    "op11_term_pipeline": lexical_search.op11_term_pipeline,
    "op12_reversible_lines": line_dedup.op12_reversible_lines,
    "op13_prefix_trie": conversation_trie.op13_prefix_trie,
}

ORACLE_SQL = {
    "op3_preference": preference_format.SQL,
    "op7_host_rules": quality_rules.SQL,
    "op11_term_pipeline": lexical_search.SQL,
    "op12_reversible_lines": line_dedup.SQL,
    "op13_prefix_trie": conversation_trie.SQL,
}
