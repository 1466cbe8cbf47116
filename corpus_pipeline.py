"""Corpus pipeline: documents to a store of token ids, by way of four decisions.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents. Mixing writes
its rows range-sorted, part by part; the store's recipes keep that order as positions.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import curriculum, decontaminate, id_store, quality_lm, simhash_dedup
from tidewake.runtime import fresh, scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_lm.keep_good(docs, _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.drop_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return curriculum.mixed(docs)


def token_store(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return id_store.store(*_in_order(docs))


def _in_order(docs: DataFrame) -> tuple[DataFrame, None, str | None]:
    """docs with the place of each row in the files of parts that it was written to, if it comes from files."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index").schema
    except AnalysisException:
        return docs, None, None
    (place,) = fresh(docs, "place")
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).try_cast("long")
    file = F.coalesce(F.regexp_extract(F.col("_metadata.file_name"), r"-c(\d+)\.", 1).try_cast("long"), F.lit(0).cast("long"))
    return docs.withColumn(place, part * 2**40 + file * 2**32 + F.col("_metadata.row_index")), None, place


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("mixing_sources", mixing),
    ("token_id_store", token_store),
]

#: Language models, fingerprints and token ids can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{scratch(spark, 'pipeline')}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
