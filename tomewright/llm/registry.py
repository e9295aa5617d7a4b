"""The queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tomewright.llm.chat import OP6_SQL, op6_format_chats
from tomewright.llm.decontaminate import op9_decontaminate
from tomewright.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from tomewright.llm.hash_ring import op13_hash_ring
from tomewright.llm.language_id import op3_language_id
from tomewright.llm.lm_scoring import op7_lm_scoring
from tomewright.llm.mixing import op8_mix_sources
from tomewright.llm.quality_classifier import op2_quality_classifier
from tomewright.llm.quality_rules import OP4_SQL, op4_quality_rules
from tomewright.llm.simhash_dedup import op10_simhash_dedup
from tomewright.llm.substring_dedup import OP5_SQL, op5_substring_dedup
from tomewright.llm.turn_reassembly import OP12_SQL, op12_turn_reassembly
from tomewright.llm.warc import OP1_SQL, op1_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_language_id": op3_language_id,
    "op4_quality_rules": op4_quality_rules,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_format_chats": op6_format_chats,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_mix_sources": op8_mix_sources,
    "op9_decontaminate": op9_decontaminate,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_turn_reassembly": op12_turn_reassembly,
    "op13_hash_ring": op13_hash_ring,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op4_quality_rules": OP4_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op6_format_chats": OP6_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_turn_reassembly": OP12_SQL,
}
