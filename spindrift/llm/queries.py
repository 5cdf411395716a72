"""The registered queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archives, decontaminate, language, lines, neardup, packing, pii, quality, resampling, secrets, spelling, tokens, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": tokens.op1_token_counts,
    "op2_embedding_dedup": vectors.op2_embedding_dedup,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_ngram_jaccard": neardup.op4_ngram_jaccard,
    "op5_language_id": language.op5_language_id,
    "op6_pii_surrogates": pii.op6_pii_surrogates,
    "op7_arc_to_warc": archives.op7_arc_to_warc,
    "op8_lexical_packing": packing.op8_lexical_packing,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_quality_rules": quality.op12_quality_rules,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op9_line_dedup": lines.OP9_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
    "op11_importance_resampling": resampling.OP11_SQL,
    "op12_quality_rules": quality.OP12_SQL,
    "op13_spelling_variants": spelling.OP13_SQL,
}
