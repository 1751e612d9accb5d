"""The corpus queries and their SQL twins, for __spark_entry__."""

from __future__ import annotations

from . import centroid_clusters, embedding_dedup, hard_negatives, language_id, license_scan, minhash_dedup, page_text, quality_rules, sentencepiece_codec, source_mix, token_counts, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_source_mix": source_mix.op2_source_mix,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_url_filter": url_filter.op4_url_filter,
        "op5_sentencepiece_codec": sentencepiece_codec.op5_sentencepiece_codec,
        "op6_minhash_dedup": minhash_dedup.op6_minhash_dedup,
        "op7_language_id": language_id.op7_language_id,
        "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
        "op9_license_scan": license_scan.op9_license_scan,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_centroid_clusters": centroid_clusters.op11_centroid_clusters,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_page_text": page_text.op13_page_text,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_url_filter": url_filter.ORACLE_SQL,
        "op8_embedding_dedup": embedding_dedup.ORACLE_SQL,
        "op11_centroid_clusters": centroid_clusters.ORACLE_SQL,
        "op12_hard_negatives": hard_negatives.ORACLE_SQL,
        "op13_page_text": page_text.ORACLE_SQL,
    }
