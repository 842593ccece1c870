"""Queries of this subpackage and their DuckDB SQL, by name."""

from __future__ import annotations

from . import decontaminate, embeddings, filter_audit, langid, mixing, quality, secrets, simhash, substring_dedup, suffix_dedup, token_store, warc, whitening

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_quality": quality.op2_quality,
    "op3_embeddings": embeddings.op3_embeddings,
    "op4_langid": langid.op4_langid,
    "op5_warc": warc.op5_warc,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_token_store": token_store.op8_token_store,
    "op9_mixing": mixing.op9_mixing,
    "op10_secrets": secrets.op10_secrets,
    "op11_substring_dedup": substring_dedup.op11_substring_dedup,
    "op12_whitening": whitening.op12_whitening,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
ORACLES = {
    "op3_embeddings": embeddings.OP3_SQL,
    "op5_warc": warc.OP5_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op10_secrets": secrets.OP10_SQL,
    "op11_substring_dedup": substring_dedup.OP11_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
