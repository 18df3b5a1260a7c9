"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from quillon.llm import bestfit_packing, embed_dedup, exact_dedup, importance, jaccard_join, langid, mixing, packing, pii, quality, suffix_dedup, url_filter, whitening

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_quality": quality.op2_quality,
    "op3_embedding_dedup": embed_dedup.op3_embedding_dedup,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_packing": packing.op8_packing,
    "op9_mixing": mixing.op9_mixing,
    "op10_pii": pii.op10_pii,
    "op11_whitening": whitening.op11_whitening,
    "op12_bestfit_packing": bestfit_packing.op12_bestfit_packing,
    "op13_importance": importance.op13_importance,
}

ORACLES = {
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op7_url_filter": url_filter.ORACLE,
    "op9_mixing": mixing.ORACLE,
}
