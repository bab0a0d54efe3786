"""The corpus pipeline: five stages over documents, each written as Parquet and reread by the next.

Quality rules drop what they reject; of each SimHash group one document stays; paragraphs that repeat are
cut out; documents that hold a window of a benchmark item go; what is left is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagegraph.llm import bpe_automaton, decontaminate, paragraph_dedup, quality_rules, simhash
from pagegraph.session import STAGED_AS, few, stage_path, staging, table, whole

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return few(quality_rules.keep_good(docs, table(spark, sf_dir, "labels")), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return few(simhash.keep_one(docs), docs)


def repeated_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return few(paragraph_dedup.cut_repeats(docs), docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return few(decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark")), docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the token ids with their digests."""
    keep = [c for c in docs.columns if c in ("doc_id", "text", "lang", "source")]
    return few(bpe_automaton.encode(docs.select(*keep), TOKENIZER).drop("text"), docs)


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_duplicates),
    ("substring dedup", repeated_paragraphs),
    ("benchmark decontamination", benchmark_passages),
    ("bpe encoding", encoded),
]

#: Hashed n-grams, SimHash and MinHash have no form in DuckDB SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, at: str | None = None) -> DataFrame:
    """The stages over documents.

    at: a folder, shared by all executors, for what the stages write. A run that died goes on after its last whole stage
    when it is called again with the same folder; another input needs another folder, and whoever names one deletes it.
    Without it the stages go to a folder of this run, which the end of the process deletes.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        name = f"{k + 1}-{name.replace(' ', '-')}"
        to = f"{at.rstrip('/')}/{name}" if at else stage_path(spark, name)
        if not whole(spark, to):
            with staging():  # what the operator staged goes when its result is written
                stage(spark, docs, sf_dir).write.options(**STAGED_AS).mode("overwrite").parquet(to)
        docs = spark.read.parquet(to)
    return STAGES[-1][1](spark, docs, sf_dir)
