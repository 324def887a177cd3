"""The subpackage's driver queries and their DuckDB equivalents."""

from __future__ import annotations

from loomweb.llm import bpe, chat_format, decontaminate, exact_dedup, filter_audit, license_scan, media, pii, quality, simhash, token_alignment, toxicity, url_rules

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_pii": pii.op2_pii,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_media": media.op4_media,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_simhash": simhash.op6_simhash,
    "op7_url_filter": url_rules.op7_url_filter,
    "op8_bpe": bpe.op8_bpe,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_exact_dedup": exact_dedup.op11_exact_dedup,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
ORACLES = {
    "op5_chat_format": chat_format.OP5_SQL,
    "op7_url_filter": url_rules.OP7_SQL,
    "op9_license_scan": license_scan.OP9_SQL,
    "op11_exact_dedup": exact_dedup.OP11_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
