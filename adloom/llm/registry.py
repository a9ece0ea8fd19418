"""The queries of this subpackage and their SQL. The others learn, or use hashes or curves that SQL has not; tests hold them against brute force."""

from __future__ import annotations

from adloom.llm import (
    bpe,
    decontaminate,
    hilbert_shards,
    language_crf,
    license_scan,
    merkle_manifest,
    prefix_trie,
    quality_rules,
    quality_trees,
    simhash,
    toxicity,
    url_filter,
    warc_fixity,
)

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_license_scan": license_scan.query,
    "op3_hilbert_shards": hilbert_shards.query,
    "op4_bpe": bpe.query,
    "op5_decontaminate": decontaminate.query,
    "op6_quality_trees": quality_trees.query,
    "op7_warc_fixity": warc_fixity.query,
    "op8_url_filter": url_filter.query,
    "op9_language_crf": language_crf.query,
    "op10_simhash": simhash.query,
    "op11_merkle_manifest": merkle_manifest.query,
    "op12_prefix_trie": prefix_trie.query,
    "op13_toxicity": toxicity.query,
}
ORACLE: dict[str, str] = {
    "op5_decontaminate": decontaminate.SQL,
    "op7_warc_fixity": warc_fixity.SQL,
    "op8_url_filter": url_filter.SQL,
    "op11_merkle_manifest": merkle_manifest.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
}
