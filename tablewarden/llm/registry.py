"""The queries of this subpackage, and their SQL where SQL can express them."""

from . import conversation_repair, exact_dedup, language_id, main_text, merkle_manifest, minhash_forest, packing, quality_rules, suffix_dedup, token_codec, token_store, vector_search, warc

QUERIES = {
    "op1_token_store": token_store.query,
    "op2_token_codec": token_codec.query,
    "op3_packing": packing.query,
    "op4_warc": warc.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_main_text": main_text.query,
    "op7_vector_search": vector_search.query,
    "op8_minhash_forest": minhash_forest.query,
    "op9_suffix_dedup": suffix_dedup.query,
    "op10_language_id": language_id.query,
    "op11_quality_rules": quality_rules.query,
    "op12_conversation_repair": conversation_repair.query,
    "op13_merkle_manifest": merkle_manifest.query,
}

ORACLES: dict[str, str] = {
    "op7_vector_search": vector_search.SQL,
    "op4_warc": warc.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op11_quality_rules": quality_rules.SQL,
    "op12_conversation_repair": conversation_repair.SQL,
    "op13_merkle_manifest": merkle_manifest.SQL,
}
