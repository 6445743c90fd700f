"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from tidelog.llm import decontaminate, idstore, language, mixing, pii, sharding, simhash, sketches, tokens, toxicity

QUERIES = {
    "op1_token_counts": tokens.query,
    "op2_decontamination": decontaminate.query,
    "op3_simhash": simhash.query,
    "op4_sharding": sharding.query,
    "op5_language_id": language.query,
    "op6_id_store": idstore.query,
    "op7_sketches": sketches.query,
    "op8_toxicity": toxicity.query,
    "op9_mixing": mixing.query,
    "op10_pii": pii.query,
}

ORACLE_SQL: dict[str, str] = {"op2_decontamination": decontaminate.ORACLE, "op9_mixing": mixing.ORACLE}
