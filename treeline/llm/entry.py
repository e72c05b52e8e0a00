"""Queries of this subpackage and their SQL, for the entry file."""

from __future__ import annotations

from . import byte_bpe, exact_dedup, language_id, mixing, near_dedup, pii, telephony, toxicity, url_filter, warc

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_telephony": telephony.op2_telephony,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_pii": pii.op4_pii,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_warc": warc.op8_warc,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_language": language_id.op10_language,
}
SQL = {
    "op1_near_dedup": near_dedup.OP1_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op7_url_filter": url_filter.OP7_SQL,
    "op8_warc": warc.OP8_SQL,
}
