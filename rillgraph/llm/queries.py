"""The corpus operators' queries and SQL, for the driver's entry point."""

from __future__ import annotations

from . import decontaminate, exact_dedup, language_id, pii, sentencepiece_codec, simhash, token_counts, toxicity, url_filter, warc

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_pii": pii.op2_pii,
    "op3_sentencepiece": sentencepiece_codec.op3_sentencepiece,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_warc": warc.op7_warc,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_token_counts": token_counts.op10_token_counts,
}

SQL = {
    "op7_warc": warc.SQL,
    "op8_url_filter": url_filter.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
}
