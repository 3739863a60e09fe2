"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from tidemark.llm import bpe, lm, mixing, neighbours, quality, secret_scan, sharding, simhash, token_store, url_filter, vector_codes, warc, whitening

QUERIES = {
    "op1_token_store": token_store.op1_token_store,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_mixing": mixing.op3_mixing,
    "op4_neighbours": neighbours.op4_neighbours,
    "op5_simhash": simhash.op5_simhash,
    "op6_bpe": bpe.op6_bpe,
    "op7_quality": quality.op7_quality,
    "op8_sharding": sharding.op8_sharding,
    "op9_warc": warc.op9_warc,
    "op10_lm": lm.op10_lm,
    "op11_secret_scan": secret_scan.op11_secret_scan,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_whitening": whitening.op13_whitening,
}
SQL = {"op2_url_filter": url_filter.SQL, "op3_mixing": mixing.SQL, "op9_warc": warc.SQL, "op11_secret_scan": secret_scan.SQL, "op12_vector_codes": vector_codes.SQL}
