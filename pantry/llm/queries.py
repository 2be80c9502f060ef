"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chunk_dedup, decontaminate, line_dedup, quality, sentencepiece_viterbi, simhash_dedup, suffix_dedup, topk, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_topk": topk.op2_topk,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_warc": warc.op4_warc,
    "op5_simhash_dedup": simhash_dedup.op5_simhash_dedup,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_chunk_dedup": chunk_dedup.op7_chunk_dedup,
    "op8_sentencepiece": sentencepiece_viterbi.op8_sentencepiece,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op2_topk": topk.OP2_SQL,
    "op4_warc": warc.OP4_SQL,
}
