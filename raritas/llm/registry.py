"""The registered queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from raritas.llm import (
    bpe_lexicon,
    centroids,
    decontaminate,
    langid,
    mixing,
    near_join,
    secret_scan,
    spot_signatures,
    token_counts,
    token_files,
    url_filter,
    vector_codes,
    warc,
)

QUERIES = {
    "op1_langid": langid.query,
    "op2_secrets": secret_scan.query,
    "op3_spot_signatures": spot_signatures.query,
    "op4_token_counts": token_counts.query,
    "op5_warc": warc.query,
    "op6_decontaminate": decontaminate.query,
    "op7_token_files": token_files.query,
    "op8_url_filter": url_filter.query,
    "op9_mixing": mixing.query,
    "op10_near_join": near_join.query,
    "op11_bpe_lexicon": bpe_lexicon.query,
    "op12_centroids": centroids.query,
    "op13_vector_codes": vector_codes.query,
}

ORACLES = {
    "op3_spot_signatures": spot_signatures.SQL,
    "op5_warc": warc.SQL,
    "op8_url_filter": url_filter.SQL,
    "op9_mixing": mixing.SQL,
    "op12_centroids": centroids.SQL,
    "op13_vector_codes": vector_codes.SQL,
}
