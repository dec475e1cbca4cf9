"""The corpus operators' queries and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, embeddings, fim, substrings
from .classlm import op7_class_lm
from .decontam import op8_benchmark_decontamination
from .embeddings import op4_embedding_near_dedup
from .fim import op13_fill_in_middle
from .jaccard import op6_ngram_jaccard_join
from .langid import op2_language_id
from .mixing import op1_source_mixing
from .packing import op11_pattern_packing
from .pii import op5_pii_pseudonyms
from .substrings import op3_substring_dedup
from .tokens import op10_token_files
from .toxicity import op9_toxicity
from .whitening import op12_embedding_whitening


OPERATORS = (
    op1_source_mixing,
    op2_language_id,
    op3_substring_dedup,
    op4_embedding_near_dedup,
    op5_pii_pseudonyms,
    op6_ngram_jaccard_join,
    op7_class_lm,
    op8_benchmark_decontamination,
    op9_toxicity,
    op10_token_files,
    op11_pattern_packing,
    op12_embedding_whitening,
    op13_fill_in_middle,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_substring_dedup": substrings.ORACLE,
        "op4_embedding_near_dedup": embeddings.ORACLE,
        "op8_benchmark_decontamination": decontam.ORACLE,
        "op13_fill_in_middle": fim.ORACLE,
    }
