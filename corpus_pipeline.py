"""From raw documents to packed sequences: quality rules, toxicity, near-duplicates, packing.

Every stage takes all documents that the one before kept and returns the columns of ``documents``, but the last, which
returns the pieces of packed sequences (see ``headway.llm.packing``).

The third stage stands in for SimHash near-dedup with five-word shingles at a similarity of 0.8: texts that similar differ in
up to 13 of 64 bits and more, where no grid of ``headway.llm.simhash`` is selective, so ``headway.llm.shingles`` finds the
candidates by MinHash and compares the shingles exactly.

Null ids and texts, empty and repeated rows and empty tables go through as each operator defines it (a null text has no
words, so the first stage rejects it); columns of the documents keep their values, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm import packing, quality, shingles, toxicity
from headway.llm.common import cut, fold, scope, table
from headway.llm.queries import TOKENIZER, tokenizer_path


def _kept(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stage keeps of documents, with their own columns: those that it doesn't use go by other names meanwhile, so none is replaced."""
    used = ("doc_id", "text", "lang")
    names = [c if c in used else f"__own_{i}" for i, c in enumerate(docs.columns)]
    return stage(docs.toDF(*names)).select(*names).toDF(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and those with proven cutoffs."""
    return _kept(docs, lambda d: quality.judge_documents(d, table(spark, sf_dir, "labels")).filter("kept"))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    model = toxicity.train(docs.filter(fold("doc_id", 4) != 2), table(spark, sf_dir, "labels"))
    return _kept(docs, lambda d: toxicity.score(d, model).filter(F.col("score") < toxicity.THRESHOLD))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: five-word shingles, similarity of at least 0.8."""
    return _kept(docs, shingles.keep_one)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in packed sequences."""
    return packing.pack(docs, tokenizer_path(TOKENIZER))


STAGES = [("quality_rules", quality_rules), ("toxicity", without_toxic), ("simhash_near_dedup", without_near_duplicates), ("packing", packed)]

#: Several stages (the fitted field, the fingerprints, the tokenizer) have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scope():  # what a stage has written for itself goes when its result is there
            docs = cut(stage(spark, docs, sf_dir), keep=True)
    return docs
