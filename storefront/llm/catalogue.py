"""The registered queries of this package and their SQL."""

from __future__ import annotations

from storefront.llm import (align, byte_bpe, chat_format, class_lm, decontaminate, exact_dedup, language_id, line_dedup, near_dedup,
                            phrases, quality, simhash, toxicity)

QUERIES = {
    "op6_language_id": language_id.op6_language_id,
    "op4_class_lm": class_lm.op4_class_lm,
    "op3_toxicity": toxicity.op3_toxicity,
    "op7_quality": quality.op7_quality,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op2_chat_formatting": chat_format.op2_chat_formatting,
    "op9_byte_bpe": byte_bpe.op9_byte_bpe,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op11_simhash": simhash.op11_simhash,
    "op12_align": align.op12_align,
    "op13_phrases": phrases.op13_phrases,
}

SQL = {
    "op8_line_dedup": line_dedup.OP8_SQL,
    "op10_decontamination": decontaminate.OP10_SQL,
    "op2_chat_formatting": chat_format.OP2_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op13_phrases": phrases.OP13_SQL,
}
