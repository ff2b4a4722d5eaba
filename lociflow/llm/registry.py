"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, chat, decontamination, jaccard, line_dedup, mjpeg, negatives, packing, pii, quality, quality_rules, repair, sharding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_media_avi": mjpeg.op2_media_avi,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_pack_tokens": packing.op4_pack_tokens,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op6_jaccard_components": jaccard.op6_jaccard_components,
    "op7_byte_bpe": byte_bpe.op7_byte_bpe,
    "op8_chat_prefix_targets": chat.op8_chat_prefix_targets,
    "op9_pii_spans": pii.op9_pii_spans,
    "op10_rendezvous_sharding": sharding.op10_rendezvous_sharding,
    "op11_conversation_repair": repair.op11_conversation_repair,
    "op12_quality_rules": quality_rules.op12_quality_rules,
    "op13_hard_negatives": negatives.op13_hard_negatives,
    "media_clips": mjpeg.media_clips,
    "quality_rule_ablations": quality_rules.quality_rule_ablations,
}

SQL: dict[str, str] = {
    "op1_decontamination": decontamination.OP1_SQL,
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op8_chat_prefix_targets": chat.OP8_SQL,
    "op11_conversation_repair": repair.OP11_SQL,
    "op12_quality_rules": quality_rules.OP12_SQL,
    "op13_hard_negatives": negatives.OP13_SQL,
    "quality_rule_ablations": quality_rules.ABLATIONS_SQL,
}
