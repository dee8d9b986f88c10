"""A corpus pipeline: documents through five operators, each stage over all that the one before kept.

1. language id: documents without a language go (no text, or no letter in it).
2. near duplicates: one document of each group of similar ones stays (five-word shingles, similarity 0.8).
3. decontamination: documents with a window of the benchmark go.
4. mixing: each document as often as the schedule of its source takes it; those that it does not take go.
5. token ids: all texts as ids in files, read back.

SQL cannot express the stages: languages are learned, and the mix follows a schedule. tests/llm holds them against
brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, language, mixing, set_join, tokens
from lodestone.llm.common import save, small_batches, table
from lodestone.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return language.predict(docs, language.learn(docs)).filter(F.col("lang_pred") != language.UNKNOWN).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return set_join.one_of_each(docs, 5, 8, 10)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.read(tokens.write(docs, tokenizer_path()))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("token_output", token_output),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
