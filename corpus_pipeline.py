"""Corpus pipeline: STAGES in order, each ``(spark, docs, sf_dir) -> DataFrame``.

Each stage gets what the one before kept, written as Parquet and read again. All
but the last return the columns of ``documents``; the last one returns digests of
the token ids, one row per document of the mix (a document that the mix takes
twice is there twice). What a stage does with nulls, empty and repeated rows is
said in its operator's module. ``labels`` of ``sf_dir`` train the toxicity model;
nothing else is read beside ``docs``.

No SQL can state the learned and the near-duplicate stages, so ``ORACLE_SQL`` is
None; tests/llm checks each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import byte_bpe, jaccard_join, mixing, secrets, toxicity
from quarry.llm.queries import table, tokenizer
from quarry.llm.storage import Stage


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.drop_near_duplicates(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are masked."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in mixing order, each as often as the mix takes it."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and digests of token ids and of what they decode to."""
    return byte_bpe.token_digests(docs, *tokenizer())


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("byte_bpe", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs, stage = table(spark, sf_dir, "documents"), Stage(spark, "pipeline")
    for name, function in STAGES[:-1]:
        docs = stage.write(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
