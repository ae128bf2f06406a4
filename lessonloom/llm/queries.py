"""Queries of the training-data operators, for the registry."""

from __future__ import annotations

import corpus_pipeline

from lessonloom.llm import oracles
from lessonloom.llm.byte_bpe import op2_byte_bpe
from lessonloom.llm.conversation_repair import op12_conversation_repair
from lessonloom.llm.hard_negatives import op13_hard_negatives
from lessonloom.llm.jaccard_join import op10_jaccard_join
from lessonloom.llm.language_id import op6_language_id
from lessonloom.llm.line_dedup import op11_line_dedup
from lessonloom.llm.quality_rules import op3_quality_rules
from lessonloom.llm.suffix_dedup import op1_suffix_dedup
from lessonloom.llm.substring_dedup import op9_substring_dedup
from lessonloom.llm.source_mixing import op7_source_mixing
from lessonloom.llm.token_counts import op8_token_counts
from lessonloom.llm.toxicity import op5_toxicity
from lessonloom.llm.weighted_sampling import op4_weighted_sampling

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_quality_rules": op3_quality_rules,
    "op4_weighted_sampling": op4_weighted_sampling,
    "op5_toxicity": op5_toxicity,
    "op6_language_id": op6_language_id,
    "op7_source_mixing": op7_source_mixing,
    "op8_token_counts": op8_token_counts,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_line_dedup": op11_line_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = dict(oracles.ORACLES)
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
