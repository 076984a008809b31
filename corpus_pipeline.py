"""A training corpus from documents: language, near duplicates, benchmark passages, mix and shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and reads it again as the
documents of the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdnet.llm import decontaminate, languages, mixing, neardup, sharding
from crowdnet.scratch import Scratch

#: A document stays if its best language is at least this likely.
LEAST_SCORE = 0.5
SHARDS = 8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language that is likely enough, go."""
    model = languages.fit(docs, sample_key=F.col("doc_id"))
    return languages.without_languages(docs, model, LEAST_SCORE, prefix="_stage_")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays: five-word shingles, similarity of 0.8."""
    return neardup.without_near_duplicates(docs, shingle=5, percent=80, prefix="_stage_")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, exact or edited, go."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_contaminated(docs, bench, prefix="_stage_")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to the square root of their sizes; a document may occur more than once."""
    return mixing.mix(docs, power=0.5, seed=17, prefix="_stage_").select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard and slot; copies of a text are in one shard."""
    return sharding.shard_rows(docs, shards=SHARDS, out="shard", slot="slot")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mix", mix), ("shards", shards)]

#: Language identification, MinHash and Karmarkar-Karp differencing aren't SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for name, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return docs
