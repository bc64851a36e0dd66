"""A corpus through five stages: quality, near duplicates, benchmark leaks, mixing, token records.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; the first four return documents
with the columns they had, the last what it reads back from the record files it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.bagminhash import keep_one
from lodestrata.llm.common import new_path
from lodestrata.llm.decontaminate import drop_leaks
from lodestrata.llm.mixing import mixed_documents
from lodestrata.llm.quality import keep_good
from lodestrata.llm.queries import vocabulary
from lodestrata.llm.records import read_records, write_records


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quadratic discriminant does not reject (score below 0.7)."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group linked by weighted similarity 0.8 or more."""
    return keep_one(docs, threshold=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, 0 to 2 times, as the mix by target weights takes them."""
    return mixed_documents(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records in ascending doc_id order, read back: doc_id, start, n_tokens, ids_crc32."""
    return read_records(spark, write_records(docs, vocabulary("byte_bpe_50k.json"), end_id=0))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("token_records", token_records),
]

#: SQL cannot express the classifier, the tokenizer or the mix; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir; each result is written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
