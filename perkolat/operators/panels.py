"""Panels: replicate roll-ups, long forms, audits of deltas, paired conditions, checked joins and admissible columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolled_up(df: DataFrame, keys: list[str], value: str, order: Column) -> DataFrame:
    """Per key: rows, the value of the first row by order, mean, sample deviation, least, greatest and sum."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by(v, order).alias("first"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.sum(v).alias("total"))


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(value).alias("least"), F.percentile(value, F.lit(0.5)).alias("median"), F.avg(value).alias("mean"), F.max(value).alias("greatest"))


def long_panel(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """A row for each key and column that is not null: keys, variable, value."""
    return df.unpivot(keys, values, "variable", "value").where("value is not null")


def delta_audit(df: DataFrame, keys: list[str], side: str, one: str, two: str, metrics: list[str]) -> DataFrame:
    """Per key and metric the mean of side `two` less that of side `one`, and its size; null where a side is missing."""
    long = df.where(F.col(side).isin(one, two)).unpivot([*keys, side], metrics, "metric", "value")
    mean = lambda s: F.avg(F.when(F.col(side) == s, F.col("value")))
    return long.groupBy(*keys, "metric").agg((mean(two) - mean(one)).alias("delta")).withColumn("size", F.abs("delta"))


def paired(df: DataFrame, keys: list[str], side: str, one: str, two: str, value: str) -> DataFrame:
    """Per key the greatest value of each side, and their difference; only keys that have both sides."""
    of = lambda s: F.max(F.when(F.col(side) == s, F.col(value)))
    both = df.groupBy(*keys).agg(of(one).alias("one"), of(two).alias("two"))
    return both.where("one is not null and two is not null").withColumn("difference", F.col("one") - F.col("two"))


def first_present(df: DataFrame, keys: list[str], order: Column, values: list[str]) -> DataFrame:
    """Per key and column the first value by order that is not null."""
    return df.groupBy(*keys).agg(*[F.min_by(F.col(v), F.when(F.col(v).isNotNull(), order)).alias(v) for v in values])


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the columns of its one row of right, or nulls; a key that right holds twice is an error."""
    twice = right.groupBy(*keys).count().where("count > 1").limit(1).count()
    if twice:
        raise ValueError(f"keys {keys} are not unique on the right side")
    return left.join(right, keys, "left")


def suffixed_join(left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Left join in which columns of one name get a suffix each."""
    both = [c for c in left.columns if c in right.columns and c not in keys]
    a, b = (df.withColumnsRenamed({c: c + s for c in both}) for df, s in zip((left, right), suffixes))
    return a.join(b, keys, "left")


def assert_distinct(df: DataFrame, key: str, expected: int) -> DataFrame:
    """df, if its key has so many values; else an error."""
    got = df.select(key).distinct().count()
    if got != expected:
        raise ValueError(f"{key} has {got} values, not {expected}")
    return df


def leakage_guard(predictors: list[str], outcomes: list[str]) -> None:
    if both := sorted(set(predictors) & set(outcomes)):
        raise ValueError(f"outcomes among the predictors: {both}")


def admissible(df: DataFrame, columns: list[str], least_rows: int = 20, least_values: int = 3) -> DataFrame:
    """(column_name, non_null, distinct, admissible) of the columns: at least so many rows with a value, and so many values."""
    parts = [x for i, c in enumerate(columns) for x in (F.count(c).alias(f"n{i}"), F.count_distinct(c).alias(f"d{i}"))]
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("non_null"), F.col(f"d{i}").alias("distinct")) for i, c in enumerate(columns)]))
    return df.agg(*parts).select(rows).withColumn("admissible", (F.col("non_null") >= least_rows) & (F.col("distinct") >= least_values))


def enumerated(df: DataFrame, col: str, values: list[str], ties: list[str]) -> DataFrame:
    """df with `place`, from 1, by the place of a column's value in a list, values not in it last, then by ties; for tables of results."""
    at = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, values)), F.col(col)), F.lit(0).cast("long")), F.lit(len(values) + 1).cast("long"))
    return df.withColumn("place", F.row_number().over(Window.orderBy(at, *ties)))
