"""Keyed records: resumable tasks, append-unique, manifests, column profiles, feature lists, latest and best rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pending(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks whose key is not done; null keys match null keys."""
    on = [tasks[k].eqNullSafe(done[k]) for k in keys]
    return tasks.join(done.select(*keys).distinct(), on, "left_anti")


def append_unique(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and the rows of new whose key it lacks; columns of either are kept."""
    return old.unionByName(pending(new, old, keys), allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One row for each key: new values replace old ones."""
    n = new.select(key, *[F.col(v).alias(f"_{v}") for v in values], F.lit(True).alias("_new"))
    j = old.join(n, key, "full_outer")
    return j.select(key, *[F.when(F.col("_new"), F.col(f"_{v}")).otherwise(F.col(v)).alias(v) for v in values])


def column_dictionary(df: DataFrame, order: Column) -> DataFrame:
    """Per column: type, rows, non-null rows and the first value (by order) in at most 80 characters. One pass."""
    kinds = dict(df.dtypes)
    parts = [F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("data_type"), F.col(f"n_{i}").alias("non_null"), F.col(f"e_{i}").alias("example")) for i, (c, t) in enumerate(kinds.items())]
    agg = [x for i, c in enumerate(kinds) for x in (F.count(c).alias(f"n_{i}"), F.substring(F.min_by(F.col(c).cast("string"), F.when(F.col(c).isNotNull(), order)), 1, 80).alias(f"e_{i}"))]
    return df.agg(F.count("*").alias("n_rows"), *agg).select("n_rows", F.inline(F.array(*parts)))


def feature_list(df: DataFrame, keys: list[str], col: str, sep: str = ";") -> DataFrame:
    """One row for each feature of a joined list, with its place from 1; blanks and later repeats are dropped."""
    parts = F.array_distinct(F.filter(F.transform(F.split(col, sep), lambda x: F.trim(x)), lambda x: x != ""))
    return df.select(*keys, F.posexplode(parts).alias("p", "feature")).select(*keys, (F.col("p") + 1).alias("place"), "feature")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def top_k(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).limit(k)


def hit_rate(df: DataFrame, key: str, a: Column, b: Column, k: int) -> DataFrame:
    """|top k by a and top k by b| / k; ties by key."""
    x, y = (df.orderBy(c.desc(), F.col(key)).limit(k).select(key) for c in (a, b))
    return x.join(y, key, "left_semi").agg((F.count("*") / k).alias("hit_rate"))
