"""Queries of this folder by name, and their SQL where SQL can express them."""

from corpusloom.llm.bpe_index import bpe_codec
from corpusloom.llm.density import HTML_EXTRACTION_SQL, html_extraction
from corpusloom.llm.deobfuscate import toxicity
from corpusloom.llm.license_scan import LICENSE_SCAN_SQL, license_scan
from corpusloom.llm.lloyd import CENTROID_CLUSTERS_SQL, centroid_clusters
from corpusloom.llm.mil_quality import mil_quality
from corpusloom.llm.packing import best_fit_packing
from corpusloom.llm.pq_dedup import embedding_dedup
from corpusloom.llm.preference import PREFERENCE_PROMPTS_SQL, PREFERENCE_SQL, preference_pairs, preference_prompts
from corpusloom.llm.prefix_trie import CONVERSATION_TRIE_SQL, conversation_trie
from corpusloom.llm.rules import QUALITY_RULES_SQL, quality_rules
from corpusloom.llm.simhash import simhash_dedup
from corpusloom.llm.surrogates import pii_surrogates

QUERIES = {
    "op1_license_scan": license_scan,
    "op2_mil_quality": mil_quality,
    "op3_embedding_dedup": embedding_dedup,
    "op4_bpe_codec": bpe_codec,
    "op5_preference_pairs": preference_pairs,
    "op6_pii_surrogates": pii_surrogates,
    "op7_toxicity": toxicity,
    "op8_simhash_dedup": simhash_dedup,
    "op9_quality_rules": quality_rules,
    "op10_best_fit_packing": best_fit_packing,
    "op11_html_density": html_extraction,
    "op12_conversation_trie": conversation_trie,
    "op13_centroid_clusters": centroid_clusters,
    "preference_prompts": preference_prompts,
}

ORACLE_SQL = {
    "op1_license_scan": LICENSE_SCAN_SQL,
    "op5_preference_pairs": PREFERENCE_SQL,
    "op9_quality_rules": QUALITY_RULES_SQL,
    "op11_html_density": HTML_EXTRACTION_SQL,
    "op12_conversation_trie": CONVERSATION_TRIE_SQL,
    "op13_centroid_clusters": CENTROID_CLUSTERS_SQL,
    "preference_prompts": PREFERENCE_PROMPTS_SQL,
}
