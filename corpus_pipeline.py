"""A training-data pipeline over ``documents``: each stage reads what the stage before it wrote.

Stages take ``(spark, docs, sf_dir)``.  All but the last return the columns of ``docs``:

1. quality: documents that the classifier rejects go (score below 0.3);
2. line dedup: later occurrences of three-line windows are cut from the texts, ``n_chars`` follows;
3. near-dedup: the document with the smallest id of each group stays; links are pairs whose five-word
   shingles are similar to 0.8 or more;
4. decontamination: documents of which a twentieth or more is benchmark text go;
5. packing: the documents' token ids as pieces in sequences of at most 4096 tokens.

Nulls, empty texts, ties, repeated rows and empty tables are handled as the operators define.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, line_dedup, packing, quality, similar, storage
from quire.session import ship


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return similar.keep_first(docs, k=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier and the fingerprints can't be said in SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = storage.write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
