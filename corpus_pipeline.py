"""A training corpus from raw documents: quality, exact copies, near copies, packed sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows the one before it kept.  ``run`` writes each
stage's rows as Parquet to the shared folder and reads them again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigsearch.llm import exact, packing, quality, simhash
from sigsearch.llm.common import table, written
from sigsearch.llm.queries import tokenizer_file


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows, does not reject."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of fingerprints (three-word shingles) linked at 3 or fewer differing bits, the row with the smallest doc_id."""
    return simhash.deduplicate(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in sequences of 2048 tokens, with their ids."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"), keep_ids=True)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", exact_copies),
    ("simhash near-dedup", near_copies),
    ("best-fit packing", packed),
]
#: A fitted classifier and a subword tokenizer have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
