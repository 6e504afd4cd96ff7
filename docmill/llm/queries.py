"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docmill.llm.decontamination import op10_decontamination
from docmill.llm.language_id import op11_language_id
from docmill.llm.line_dedup import OP2_SQL, op2_line_dedup
from docmill.llm.lm_scoring import op9_lm_scoring
from docmill.llm.packing import op4_packing
from docmill.llm.phrases import OP12_SQL, op12_phrases
from docmill.llm.quality_classifier import op8_quality_classifier
from docmill.llm.quality_rules import op5_quality_rules
from docmill.llm.sharding import op3_sharding
from docmill.llm.simhash import op1_simhash
from docmill.llm.source_divergence import OP13_SQL, op13_source_divergence
from docmill.llm.substring_dedup import OP6_SQL, op6_substring_dedup
from docmill.llm.suffix_array import OP7_SQL, op7_suffix_array

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_line_dedup": op2_line_dedup,
    "op3_sharding": op3_sharding,
    "op4_packing": op4_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_suffix_array": op7_suffix_array,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_decontamination": op10_decontamination,
    "op11_language_id": op11_language_id,
    "op12_phrases": op12_phrases,
    "op13_source_divergence": op13_source_divergence,
}
ORACLE_SQL: dict[str, str] = {"op2_line_dedup": OP2_SQL, "op6_substring_dedup": OP6_SQL, "op7_suffix_array": OP7_SQL, "op12_phrases": OP12_SQL, "op13_source_divergence": OP13_SQL}
