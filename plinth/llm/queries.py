"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from plinth.llm import decontaminate, language, license, mixing, neighbours, pii, prefix_trie, simhash, sketch, spelling, substring, tokens, url_filter

QUERIES = {
    "op1_source_mixing": mixing.op1,
    "op2_license_scan": license.op2,
    "op3_token_output": tokens.op3,
    "op4_url_filter": url_filter.op4,
    "op5_pii": pii.op5,
    "op6_simhash_near_dedup": simhash.op6,
    "op7_benchmark_decontamination": decontaminate.op7,
    "op8_substring_dedup": substring.op8,
    "op9_document_fingerprint": sketch.op9,
    "op10_language_id": language.op10,
    "op11_conversation_trie": prefix_trie.op11,
    "op12_nearest_neighbours": neighbours.op12,
    "op13_spelling_variants": spelling.op13,
}

ORACLES = {
    "op7_benchmark_decontamination": decontaminate.ORACLE,
    "op8_substring_dedup": substring.ORACLE,
    "op12_nearest_neighbours": neighbours.ORACLE,
}
