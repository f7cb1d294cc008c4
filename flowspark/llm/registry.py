"""Registered queries of the operators and their SQL checks."""

from __future__ import annotations

from flowspark.llm import ann, dialogue, language, lines, lm, mixing, passages, phrases, pieces, quality, simhash, toxicity, vector_dups

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_ann": ann.query,
    "op3_sentencepiece": pieces.query,
    "op4_passages": passages.query,
    "op5_vector_dups": vector_dups.query,
    "op6_simhash": simhash.query,
    "op7_quality": quality.query,
    "op8_toxicity": toxicity.query,
    "op9_lm": lm.query,
    "op10_line_dedup": lines.query,
    "op11_language": language.query,
    "op12_phrases": phrases.query,
    "op13_dialogue": dialogue.query,
}

ORACLES = {
    "op1_mixing": mixing.ORACLE,
    "op5_vector_dups": vector_dups.ORACLE,
    "op10_line_dedup": lines.ORACLE,
    "op12_phrases": phrases.ORACLE,
    "op13_dialogue": dialogue.ORACLE,
}
