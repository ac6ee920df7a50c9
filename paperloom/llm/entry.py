"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .annulus import OP12_SQL, op12_annulus_clusters
from .chat import OP1_SQL, op1_chat_prefix_targets
from .cws import op2_document_fingerprints
from .language import op11_language_id
from .media import op8_media_columns
from .ngram_importance import OP13_SQL, op13_target_importance
from .packing import op7_retrieval_packing
from .quality import op9_quality_classifier
from .repeats import OP4_SQL, op4_suffix_array_dedup
from .simhash import op5_simhash_near_dedup
from .token_counts import op6_token_counts
from .warc import OP10_SQL, op10_warc_revisits
from .word_table import op3_bpe_word_table

QUERIES = {
    "op1_chat_prefix_targets": op1_chat_prefix_targets,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_bpe_word_table": op3_bpe_word_table,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_retrieval_packing": op7_retrieval_packing,
    "op8_media_columns": op8_media_columns,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_warc_revisits": op10_warc_revisits,
    "op11_language_id": op11_language_id,
    "op12_annulus_clusters": op12_annulus_clusters,
    "op13_target_importance": op13_target_importance,
}

#: DuckDB can't run a tokenizer's merges, checksums of ids, sampled draws or fingerprints; tests compare those with brute force.
ORACLE: dict[str, str] = {"op1_chat_prefix_targets": OP1_SQL, "op4_suffix_array_dedup": OP4_SQL, "op10_warc_revisits": OP10_SQL, "op12_annulus_clusters": OP12_SQL, "op13_target_importance": OP13_SQL}
