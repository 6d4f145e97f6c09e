"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op01_suffix_array, op02_decision_list, op03_line_deletions, op04_anchor_pii, op05_fm_index, op06_decontaminate, op07_simhash_cover, op08_deleted_interpolation, op09_arrow_tokens, op10_flow_mix, op11_vector_codes, op12_randomness_secrets, op13_merkle_manifest

_MODULES = (
    (op01_suffix_array, "op1_suffix_array"),
    (op02_decision_list, "op2_decision_list"),
    (op03_line_deletions, "op3_line_deletions"),
    (op04_anchor_pii, "op4_anchor_pii"),
    (op05_fm_index, "op5_fm_index"),
    (op06_decontaminate, "op6_decontaminate"),
    (op07_simhash_cover, "op7_simhash_cover"),
    (op08_deleted_interpolation, "op8_deleted_interpolation"),
    (op09_arrow_tokens, "op9_arrow_tokens"),
    (op10_flow_mix, "op10_flow_mix"),
    (op10_flow_mix, "mix_overlapping_sources"),
    (op11_vector_codes, "op11_vector_codes"),
    (op12_randomness_secrets, "op12_randomness_secrets"),
    (op13_merkle_manifest, "op13_merkle_manifest"),
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(module, name) for module, name in _MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for module, name in _MODULES if getattr(module, "SQL", None) and name.startswith("op")}
