"""Names of the queries of this folder and their SQL."""

from __future__ import annotations

import corpus_pipeline
from disputa.llm import bpe, chat, html, jpeg, langid, lm, mixing, neardup_texts, neardup_vectors, quality

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_ngram_jaccard": neardup_texts.op1_ngram_jaccard,
    "op6_vector_neardup": neardup_vectors.op6_vector_neardup,
    "op2_temperature_mix": mixing.op2_temperature_mix,
    "op3_prefix_targets": chat.op3_prefix_targets,
    "op9_main_text": html.op9_main_text,
    "op8_progressive_jpeg": jpeg.op8_progressive_jpeg,
    "op7_gru_scores": lm.op7_gru_scores,
    "op4_quality": quality.op4_quality,
    "op5_language_id": langid.op5_language_id,
    "op10_byte_bpe": bpe.op10_byte_bpe,
}

ORACLES: dict[str, str] = chat.ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
