"""The registered queries of these operators and their SQL equivalents."""

from __future__ import annotations

from proofspark.llm import classifier, embeddings, fim, lines, minhash, mixing, packing, pii, quality, sharding, sql, suffix, trie, urls

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_embedding_dedup": embeddings.op3_embedding_dedup,
    "op4_suffix_array_dedup": suffix.op4_suffix_array_dedup,
    "op5_sharding": sharding.op5_sharding,
    "op6_pii": pii.op6_pii,
    "op7_minhash_dedup": minhash.op7_minhash_dedup,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_quality_classifier": classifier.op9_quality_classifier,
    "op10_packing": packing.op10_packing,
    "op11_url_filters": urls.op11_url_filters,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_prefix_trie": trie.op13_prefix_trie,
}

ORACLE_SQL = {
    "op1_quality_rules": sql.QUALITY,
    "op11_url_filters": sql.URL_FILTERS,
    "op12_fill_in_middle": sql.FILL_IN_MIDDLE,
    "op13_prefix_trie": sql.PREFIX_TRIE,
}
