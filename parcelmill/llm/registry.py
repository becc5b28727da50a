"""The registered queries of this subpackage and of the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from parcelmill.llm import ann, bpe, chat, exactdup, hardneg, imatch, langid, neardup, packing, pii, prefixtrie, quality, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    return {
        "op1_cross_polytope_neighbors": ann.op1_cross_polytope_neighbors,
        "op2_residual_packing": packing.op2_residual_packing,
        "op3_imatch_fingerprints": imatch.op3_imatch_fingerprints,
        "op4_toxicity_scores": toxicity.op4_toxicity_scores,
        "op5_personal_data": pii.op5_personal_data,
        "op6_languages": langid.op6_languages,
        "op7_bpe_round_trip": bpe.op7_bpe_round_trip,
        "op8_quality_scores": quality.op8_quality_scores,
        "op9_near_duplicates": neardup.op9_near_duplicates,
        "op10_chat_masks": chat.op10_chat_masks,
        "op11_prefix_trie": prefixtrie.op11_prefix_trie,
        "op12_hard_negatives": hardneg.op12_hard_negatives,
        "op13_exact_duplicates": exactdup.op13_exact_duplicates,
        "pipeline": corpus_pipeline.run,
    }


def all_sql() -> dict[str, str]:
    return {"op11_prefix_trie": prefixtrie.OP11_SQL, "op12_hard_negatives": hardneg.OP12_SQL, "op13_exact_duplicates": exactdup.OP13_SQL}
