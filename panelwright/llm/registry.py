"""Registered queries of the training-data operators."""

from __future__ import annotations

from . import decontaminate, language, lexical, packing, quality, sharding, simhash, substring, tokencount, tokenfiles, toxicity, warc, whitening

QUERIES = {
    "op1_substring_dedup": substring.op1_query,
    "op2_language_id": language.op2_query,
    "op3_simhash_near_dedup": simhash.op3_query,
    "op4_toxicity": toxicity.op4_query,
    "op5_quality_rules": quality.op5_query,
    "op6_warc_index_merge": warc.op6_query,
    "op7_token_counts": tokencount.op7_query,
    "op8_decontaminate": decontaminate.op8_query,
    "op9_best_fit_packing": packing.op9_query,
    "op10_histogram_sharding": sharding.op10_query,
    "op11_ranked_search": lexical.op11_query,
    "op12_token_files": tokenfiles.op12_query,
    "op13_embedding_whitening": whitening.op13_query,
}
ORACLES: dict[str, str] = {
    "op1_substring_dedup": substring.OP1_SQL,
    "op6_warc_index_merge": warc.OP6_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
    "op11_ranked_search": lexical.OP11_SQL,
}


def queries() -> dict:
    """Queries by name, the pipeline included."""
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    """DuckDB SQL of the queries that it can express."""
    return dict(ORACLES)
