"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from . import decontaminate, divergence, jaccard_join, language_id, language_model, licenses, line_dedup, order_minhash, packing, personal_data, prefix_trie, quality, sharding

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_personal_data": personal_data.op2_personal_data,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_order_minhash": order_minhash.op5_order_minhash,
    "op6_lm_scoring": language_model.op6_lm_scoring,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_packing": packing.op8_packing,
    "op9_quality": quality.op9_quality,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_sharding": sharding.op13_sharding,
}

ORACLES = {
    "op4_license_scan": licenses.OP4_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op10_jaccard_join": jaccard_join.OP10_SQL,
    "op11_source_divergence": divergence.OP11_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op13_sharding": sharding.OP13_SQL,
}
