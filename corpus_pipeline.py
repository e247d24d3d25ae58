"""A training-data pipeline over documents: filter, deduplicate, decontaminate, pseudonymise, encode.

Each stage takes what its predecessor kept, is written as Parquet to the shared folder and read
again. All but the last return the columns of documents. Rows may repeat, ids and texts may
be null; see the operators for what they do with them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from truegauge.llm import byte_pairs, decontaminate, near_copies, pseudonyms, quality_rules
from truegauge.llm.common import written

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: that with the smallest id."""
    return near_copies.one_per_class(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that is mostly benchmark goes."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminated(docs, items, length="n_chars")


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms of the same format."""
    return pseudonyms.with_pseudonyms(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, packed and counted, with digests of the ids and of the text decoded from them."""
    return byte_pairs.round_trip(docs.select("doc_id", "lang", "source", "text"), "text",
                                 public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, ids="ids").drop("text")


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates),
          ("benchmark decontamination", benchmark), ("personal data", privacy), ("byte pairs", encoded)]

#: SQL can say neither the sampled near copies nor the ids; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
