"""Shared helpers: reading tables, word expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perkolat.lineage import dropped, fresh_path, shared_dir, small, swept, written

__all__ = ["dropped", "freed", "fresh_path", "shared_dir", "small", "swept", "table", "text_of", "words", "written"]

#: Fixed by the contracts: a word is a run without these six ASCII white-space characters.
SPACE_RE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(col: str | Column) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))


def freed(df: DataFrame, name: str) -> DataFrame:
    """written(), after which Spark drops the shuffle files that it took: nothing reads them again."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return written(df, name)
    finally:
        conf.set(key, before)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_RE), "")
