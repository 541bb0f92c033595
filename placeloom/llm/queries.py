"""Queries of this subpackage, and their SQL where SQL can express them."""

from . import decontam, filter_audit, html, langid, media, mixing, pii, prefix_trie, repeats, secrets, simhash, top_inner, url_rules

QUERIES = {
    "op1_benchmark_decontamination": decontam.op1_benchmark_decontamination,
    "op2_media_transport_stream": media.op2_media_transport_stream,
    "op3_language_id": langid.op3_language_id,
    "op4_url_rules": url_rules.op4_url_rules,
    "op5_remove_repeats": repeats.op5_remove_repeats,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_html_main_text": html.op7_html_main_text,
    "op8_pii_spans": pii.op8_pii_spans,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_top_inner_products": top_inner.op11_top_inner_products,
    "op12_conversation_trie": prefix_trie.op12_conversation_trie,
    "op13_filter_interactions": filter_audit.op13_filter_interactions,
}

ORACLES: dict[str, str] = {
    "op1_benchmark_decontamination": decontam.OP1_SQL,
    "op11_top_inner_products": top_inner.OP11_SQL,
    "op12_conversation_trie": prefix_trie.OP12_SQL,
    "op13_filter_interactions": filter_audit.OP13_SQL,
}
