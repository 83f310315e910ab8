"""Operators of a training-data pipeline, one module each, with the queries that apply them to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .centroid_clusters import OP11_SQL, op11_centroid_clusters
from .chat_format import OP2_SQL, op2_chat_format
from .context_tree import op6_context_tree_score
from .decontaminate import OP4_SQL, op4_benchmark_decontamination
from .lexical_search import OP13_SQL, op13_lexical_search
from .line_dedup import OP1_SQL, op1_line_dedup
from .ngram_join import OP3_SQL, op3_ngram_jaccard_join
from .quality_rules import OP10_SQL, op10_quality_rules
from .sentencepiece_codec import op8_sentencepiece
from .suffix_dedup import op9_suffix_dedup
from .token_counts import op5_token_counts
from .token_files import op7_token_files
from .warc import OP12_SQL, op12_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_line_dedup, op2_chat_format, op3_ngram_jaccard_join, op4_benchmark_decontamination, op5_token_counts,
        op6_context_tree_score, op7_token_files, op8_sentencepiece, op9_suffix_dedup, op10_quality_rules,
        op11_centroid_clusters, op12_warc, op13_lexical_search,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": OP1_SQL, "op2_chat_format": OP2_SQL, "op3_ngram_jaccard_join": OP3_SQL,
        "op4_benchmark_decontamination": OP4_SQL, "op10_quality_rules": OP10_SQL,
        "op11_centroid_clusters": OP11_SQL, "op12_warc": OP12_SQL, "op13_lexical_search": OP13_SQL,
    }
