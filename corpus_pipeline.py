"""Corpus pipeline: toxicity, quality rules, near duplicates, packing.

Each stage takes what its predecessor kept, written as Parquet and read again;
all but the last return the columns of ``documents``. Null texts are empty
(which the base quality rules reject), repeated rows are judged alike, and
columns beyond those of ``documents`` are left out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import classifier_chain, decision_list, jaccard_join, packing, wordpiece
from tessera.llm.common import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the classifier chain calls toxic go."""
    chain = classifier_chain.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return classifier_chain.score(docs.select(*COLUMNS), chain).where(~classifier_chain.is_toxic()).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that fail the base rules or meet a learned rule go."""
    judged = decision_list.judge(docs.select(*COLUMNS), table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.where(F.col("kept")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of each group of linked documents, the one of least id stays."""
    return jaccard_join.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: every kept document gets its place in a packed sequence."""
    counted = wordpiece.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return packing.best_fit_pack(counted, F.col("n_tokens") + 1)


STAGES = [("toxicity", toxicity), ("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("best-fit packing", best_fit_packing)]

#: No SQL: two stages are trained models; tests/llm/test_pipeline.py holds each stage against a loop in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
