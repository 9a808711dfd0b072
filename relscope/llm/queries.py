"""The operators' queries over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import hard_negatives, line_dedup
from .bpe import op2_byte_bpe
from .embedding_dedup import op10_embedding_near_dedup
from .hard_negatives import op11_hard_negatives
from .knn import op8_permutation_knn
from .line_dedup import op12_line_dedup
from .minhash import op7_minhash_near_dedup
from .packing import op9_best_fit_packing
from .pii import op5_personal_data
from .quality import op1_quality_classifier
from .token_counts import op4_token_counts
from .url_filters import op6_url_filters, oracle
from .warc import op3_warc
from .whitening import op13_embedding_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_warc": op3_warc,
    "op4_token_counts": op4_token_counts,
    "op5_personal_data": op5_personal_data,
    "op6_url_filters": op6_url_filters,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_permutation_knn": op8_permutation_knn,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_line_dedup": op12_line_dedup,
    "op13_embedding_whitening": op13_embedding_whitening,
}

#: The others train models, run tokenizers or approximate, which SQL can't express.
ORACLE_SQL: dict[str, str] = {"op6_url_filters": oracle(), "op11_hard_negatives": hard_negatives.oracle(), "op12_line_dedup": line_dedup.oracle()}
