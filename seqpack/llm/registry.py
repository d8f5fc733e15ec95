"""The queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from seqpack.llm import ann, bpe, decontam, langid, line_dedup, near_dedup, sharding, token_counts, toxicity, url_filter

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_bpe": bpe.op4_bpe,
    "op5_url_filters": url_filter.op5_url_filters,
    "op6_block_neighbours": ann.op6_block_neighbours,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_hilbert_shards": sharding.op8_hilbert_shards,
    "op9_decontaminate": decontam.op9_decontaminate,
    "op10_langid": langid.op10_langid,
}
ORACLES: dict[str, str] = {"op1_line_dedup": line_dedup.ORACLE, "op2_near_dedup": near_dedup.ORACLE, "op6_block_neighbours": ann.ORACLE}
