"""From documents to token files: five stages, each an operator of veilframe.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, extra
ones included, whatever their names. Every stage bears nulls in any column, empty and very long texts, ties, repeated
rows, rows that share an id or have none, and empty tables, which give empty ones; what becomes of such rows stands at
the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import decontam, jaccard, langid, mixing, tokens
from veilframe.llm.common import docs_table, materialize, new_path, release


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents whose language is rejected (null, empty or without letters, or too narrow a margin) go.

    Repeated rows are judged alike. Where no row has a label nothing is known and all go.
    """
    return langid.keep_identified(docs, langid.fit(langid.learnable(docs)))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each group of near duplicates stays, that of the smallest doc_id.

    A null id counts as the largest; of rows that share the smallest id, or have none, one stays. Rows without words are
    near to nothing and all stay.
    """
    return jaccard.keep_first(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: contaminated documents go. Each row is judged for itself; null and empty texts stay, and all do where the benchmark is empty."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: each document as often as the mix takes it, the last time its text may be cut at a word.

    A null source is one like any other, the last. Null and empty texts have no words and aren't taken.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID output: documents encoded, written to shards, and their digest read back from these: a row for each row of docs, null ids first."""
    path = new_path(spark, "tokens")
    tokens.write_tokens(docs, path, tokens.default_tokenizer())
    return tokens.token_digest(spark, path)


STAGES = [
    ("language_id", identify),
    ("ngram_jaccard_join", deduplicate),
    ("benchmark_decontamination", clean),
    ("source_mixing", mix),
    ("token_files", encode),
]

#: SQL can't express compression, sampled joins and tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = docs_table(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
