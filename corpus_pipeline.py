"""A training corpus from raw documents: classify, deduplicate three ways, pack.

Each stage works on all that the one before kept; ``run`` writes it as a table in the shared folder and reads
it back for the next. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import exact_dedup, near_dedup, packing, quality_model, substring_dedup
from cairn.llm._common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly labelled classifier doesn't reject."""
    return quality_model.without_rejected(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal up to white space."""
    return exact_dedup.first_rows(docs, in_snapshot=F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    return near_dedup.one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without the passages of 200 bytes or more that also occur elsewhere."""
    return substring_dedup.without_repeats(docs, span=200)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), length=2048, end_id=1)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("substring_dedup", passages), ("packing", pack)]

#: SQL has no tokenizer, classifier or near-duplicate search; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
