"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding. Each stage reads what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from perkolat.llm import decontaminate, mixing, quality, sharding, simhash
from perkolat.llm.common import swept, table, written

SHARDS = 16


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that a quality rule rejects; null, empty and blank texts are among them. Rows are judged one by one, whole; an
    empty table stays empty."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the least doc_id, null last; rows that repeat are one group, as are all texts without
    words. Very long texts are compared whole; an empty table stays empty."""
    swept(spark)
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a passage of the benchmark; null and empty texts hold none, and all stay where it has no item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each repetition of a document in the mix; texts without words have nothing to take and go; null sources are one source;
    rows with one doc_id and source are decided together; an empty table stays empty."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row, repeated ones and null ids included; an empty table gives no rows."""
    swept(spark)
    return sharding.shard(docs, SHARDS)


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontamination), ("source_mixing", mix), ("kd_sharding", shards)]
#: SQL can express neither similar sets nor edit matching; tests/llm/test_pipeline_brute.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
