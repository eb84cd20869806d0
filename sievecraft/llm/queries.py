"""The opN_<name> queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import centroid_clustering, embedding_dedup, exact_dedup, hard_negatives, license_scan, ngram_join, packing, secret_scan, sentencepiece_codec, substring_dedup, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
    "op5_sentencepiece": sentencepiece_codec.op5_sentencepiece,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
    "op13_centroid_clustering": centroid_clustering.op13_centroid_clustering,
}
SQL = {k: v for m in (toxicity, substring_dedup, ngram_join, embedding_dedup, sentencepiece_codec, license_scan, url_filter, secret_scan, packing, exact_dedup, hard_negatives, suffix_dedup, centroid_clustering) for k, v in m.SQL.items()}
