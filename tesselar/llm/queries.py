"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, bitplane, bitslices, fingerprints, langid, mixing, packing, phrases, prefixes, sharding, simhash, substring, wrappers

QUERIES = {
    "op1_document_fingerprints": fingerprints.op1_document_fingerprints,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_simhash_near_duplicates": simhash.op3_simhash_near_duplicates,
    "op4_substring_dedup": substring.op4_substring_dedup,
    "op5_token_bitplanes": bitplane.op5_token_bitplanes,
    "op6_shuffled_shards": sharding.op6_shuffled_shards,
    "op7_wrapper_extraction": wrappers.op7_wrapper_extraction,
    "op8_language_id": langid.op8_language_id,
    "op9_nearest_neighbours": ann.op9_nearest_neighbours,
    "op10_source_mixing": mixing.op10_source_mixing,
    "op11_benchmark_decontamination": phrases.op11_benchmark_decontamination,
    "op12_ranked_search": bitslices.op12_ranked_search,
    "op13_conversation_trie": prefixes.op13_conversation_trie,
}

ORACLES = {
    "op4_substring_dedup": substring.ORACLE,
    "op9_nearest_neighbours": ann.ORACLE,
    "op10_source_mixing": mixing.ORACLE,
    "op11_benchmark_decontamination": phrases.ORACLE,
    "op12_ranked_search": bitslices.ORACLE,
    "op13_conversation_trie": prefixes.ORACLE,
}
