"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import bpe, collocations, embedding_join, exact_dedup, language_id, lexical_search, license_scan, minhash, mixing, surrogates, token_files, toxicity, url_filter

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_minhash": minhash.op2_minhash,
    "op3_surrogates": surrogates.op3_surrogates,
    "op4_language_id": language_id.op4_language_id,
    "op5_token_files": token_files.op5_token_files,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_embedding_join": embedding_join.op9_embedding_join,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_collocations": collocations.op11_collocations,
    "op12_license_scan": license_scan.op12_license_scan,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}
SQL = {"op1_mixing": mixing.OP1_SQL, "op6_exact_dedup": exact_dedup.OP6_SQL, "op10_url_filter": url_filter.OP10_SQL, "op11_collocations": collocations.OP11_SQL, "op12_license_scan": license_scan.OP12_SQL, "op13_lexical_search": lexical_search.OP13_SQL}
