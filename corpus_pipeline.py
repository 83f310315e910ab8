"""The training-data pipeline over `documents`: quality rules, line dedup, near duplicates, decontamination, encoding.

Every stage works on all that the one before kept, and its result is written as Parquet and read again; what the stage
before left is deleted then. All stages keep every column that documents has; n_chars follows the text. The last one
adds n_tokens and ids, in place of columns of these names.

Rows without a text go with the first stage, as do those that it rejects; repeated rows are copies, of which the third
stage keeps one; a null id is kept as any other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from depscope.llm import decontaminate, line_dedup, ngram_join, quality_rules, sentencepiece_codec
from depscope.llm.scratch import release, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and so do the documents that the rules reject."""
    return quality_rules.clean(docs)


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on too many pages of their source go."""
    return line_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (five-word shingles, Jaccard 0.8) stays: the one of least id."""
    return ngram_join.one_of_each(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by phrases of the benchmark go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str, model: str | None = None) -> DataFrame:
    """Token ids of every document, with the text decoded from them."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_codec.encoded(docs, model)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("line_dedup", boilerplate),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", contamination),
    ("sentencepiece", encoding),
]

#: Near duplicates and encoding are beyond SQL; tests/llm/test_pipeline.py holds the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
