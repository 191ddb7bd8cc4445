"""The queries of this package, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, langid, pieces, pii, secrets, simhash, sketch, tokencount, urls

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
    "op3_document_fingerprints": sketch.op3_document_fingerprints,
    "op4_url_filters": urls.op4_url_filters,
    "op5_pii": pii.op5_pii,
    "op6_language_id": langid.op6_language_id,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_token_counts": tokencount.op9_token_counts,
    "op10_secret_scans": secrets.op10_secret_scans,
}

ORACLES = {**chat.ORACLE, **decontaminate.ORACLE, **urls.ORACLE}
