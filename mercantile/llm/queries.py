"""Queries of this subpackage, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, embed_dedup, importance, language, licenses, lm_score, manifest, minhash, packing, secret_scan, sql, substring_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secret_scan.query,
    "op2_decontamination": decontam.query,
    "op3_toxicity": toxicity.query,
    "op4_embedding_near_dedup": embed_dedup.query,
    "op5_license_scan": licenses.query,
    "op6_lm_scoring": lm_score.query,
    "op7_chat_formatting": chat.query,
    "op8_packing": packing.query,
    "op9_minhash_near_dedup": minhash.query,
    "op10_suffix_array_dedup": substring_dedup.query,
    "op11_importance_resampling": importance.query,
    "op12_merkle_manifest": manifest.query,
    "op13_language_id": language.query,
}

#: The others hang on models, thresholds of entropy, templates or a tokenizer; tests/llm holds them
#: against brute force, round trips or held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": sql.DECONTAMINATION,
    "op4_embedding_near_dedup": sql.EMBEDDINGS,
    "op7_chat_formatting": sql.CHAT,
    "op9_minhash_near_dedup": sql.NEAR_DUPLICATES,
    "op10_suffix_array_dedup": sql.SUBSTRINGS,
    "op11_importance_resampling": sql.IMPORTANCE,
    "op12_merkle_manifest": sql.MANIFEST,
}
