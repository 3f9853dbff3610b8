"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridlore.llm import bpe, chat_format, decontaminate, divergence, line_dedup, maxent_lm, near_dedup, periodic_runs, quality_net, quality_rules, sharding, substring_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_noisy_or": toxicity.op2_noisy_or,
    "op3_hashed_maxent": maxent_lm.op3_hashed_maxent,
    "op4_virtual_slots": sharding.op4_virtual_slots,
    "op5_interval_expansion": substring_dedup.op5_interval_expansion,
    "op6_decision_list": quality_rules.op6_decision_list,
    "op7_spaced_seeds": decontaminate.op7_spaced_seeds,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_minhash": near_dedup.op10_minhash,
    "op11_period_tiles": periodic_runs.op11_period_tiles,
    "op12_count_bitmaps": divergence.op12_count_bitmaps,
    "op13_byte_cnn": quality_net.op13_byte_cnn,
}
SQL: dict[str, str] = {"op1_chat_format": chat_format.OP1_SQL, "op5_interval_expansion": substring_dedup.OP5_SQL, "op9_line_dedup": line_dedup.OP9_SQL, "op10_minhash": near_dedup.OP10_SQL, "op12_count_bitmaps": divergence.OP12_SQL}
