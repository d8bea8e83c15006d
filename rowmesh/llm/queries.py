"""The queries of this subpackage, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowmesh.llm import language, licenses, minhash, mixing, packing, quality, simhash, substring, topk, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_pareto_mixing": mixing.op2_pareto_mixing,
    "op3_minhash_fingerprints": minhash.op3_minhash_fingerprints,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op5_substring_dedup": substring.op5_substring_dedup,
    "op6_warc_bundles": warc.op6_warc_bundles,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_nb_svm_quality": quality.op8_nb_svm_quality,
    "op9_unigram_language_id": language.op9_unigram_language_id,
    "op10_threshold_top_k": topk.op10_threshold_top_k,
}
ORACLE_SQL: dict[str, str] = {"op1_license_scan": licenses.op1_sql(), "op2_pareto_mixing": mixing.OP2_SQL}
