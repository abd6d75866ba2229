"""The registered queries of this subpackage and the SQL that DuckDB can check them with."""

from __future__ import annotations

from editloom.llm import fingerprint, lexical_search, merkle, mixing, near_dedup, packing, quality, sentence_pieces, token_output, toxicity, url_filter, vector_dedup, warc

QUERIES = {
    "op1_fingerprints": fingerprint.op1_fingerprints,
    "op2_token_output": token_output.op2_token_output,
    "op3_quality": quality.op3_quality,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_mixing": mixing.op5_mixing,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_packing": packing.op8_packing,
    "op9_warc": warc.op9_warc,
    "op10_vector_dedup": vector_dedup.op10_vector_dedup,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_sentencepiece": sentence_pieces.op12_sentencepiece,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}

ORACLE: dict[str, str] = {
    "op5_mixing": mixing.OP5_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op9_warc": warc.OP9_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op13_lexical_search": lexical_search.OP13_SQL,
}
