"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestry.llm.chat import op9_snapshot_collapse
from attestry.llm.decontaminate import op10_suffix_decontamination
from attestry.llm.jaccard import op4_token_combination_join
from attestry.llm.merkle import op13_merkle_manifest
from attestry.llm.packing import op1_variable_best_fit
from attestry.llm.quality import op2_decision_list
from attestry.llm.ranking import op11_ranked_search
from attestry.llm.rollups import op8_delta_rollup
from attestry.llm.sharding import op5_virtual_slots
from attestry.llm.sql import ORACLE
from attestry.llm.substring import op7_paragraph_minhash
from attestry.llm.tokens import op6_token_files
from attestry.llm.urls import op3_character_ratio
from attestry.llm.warc import op12_warc_segments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_variable_best_fit": op1_variable_best_fit,
    "op2_decision_list": op2_decision_list,
    "op3_character_ratio": op3_character_ratio,
    "op4_token_combination_join": op4_token_combination_join,
    "op5_virtual_slots": op5_virtual_slots,
    "op6_token_files": op6_token_files,
    "op7_paragraph_minhash": op7_paragraph_minhash,
    "op8_delta_rollup": op8_delta_rollup,
    "op9_snapshot_collapse": op9_snapshot_collapse,
    "op10_suffix_decontamination": op10_suffix_decontamination,
    "op11_ranked_search": op11_ranked_search,
    "op12_warc_segments": op12_warc_segments,
    "op13_merkle_manifest": op13_merkle_manifest,
}

__all__ = ["ORACLE", "QUERIES"]
