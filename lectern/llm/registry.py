"""The operators' queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from lectern.llm import decontamination, embeddings, language, licences, lines, packing, scoring, sharding, simhash, tokens

QUERIES = {
    "op1_token_files": tokens.op1_token_files,
    "op2_pattern_packing": packing.op2_pattern_packing,
    "op3_language_id": language.op3_language_id,
    "op4_lm_scores": scoring.op4_lm_scores,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_byte_shards": sharding.op6_byte_shards,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op8_licence_scan": licences.op8_licence_scan,
    "op9_embedding_near_dedup": embeddings.op9_embedding_near_dedup,
    "op10_decontamination": decontamination.op10_decontamination,
}

ORACLES: dict[str, str] = {
    "op5_line_dedup": lines.OP5_SQL,
    "op6_byte_shards": sharding.OP6_SQL,
    "op9_embedding_near_dedup": embeddings.OP9_SQL,
    "op10_decontamination": decontamination.OP10_SQL,
}
