"""Resampling by hash, so that any engine draws the same: permutations, bootstrap correlations, shuffled baselines, folds, lines in two predictors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import leave_group_out, ranked


def md5(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def permuted(df: DataFrame, key: str, x: str, y: str, reps: int, seed: int) -> DataFrame:
    """(rep, x, y): in each of reps permutations a row keeps x and gets y of the row whose hash has its place."""
    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("key"), F.col(x).alias("x"), F.col(y).alias("y"))
    each = own.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    a = each.withColumn("i", F.row_number().over(Window.partitionBy("rep").orderBy("key"))).select("rep", "i", "x")
    b = each.withColumn("i", F.row_number().over(Window.partitionBy("rep").orderBy(md5(F.lit(seed), F.col("rep"), F.col("key")), "key"))).select("rep", "i", "y")
    return a.join(b, ["rep", "i"]).select("rep", "x", "y")


def permutation_p(df: DataFrame, key: str, x: str, y: str, reps: int, seed: int) -> DataFrame:
    """(r, p): the correlation and the share of permutations whose correlation is at least as large, without a correction."""
    r = df.agg(F.corr(x, y).alias("r"))
    drawn = permuted(df, key, x, y, reps, seed).groupBy("rep").agg(F.corr("x", "y").alias("rs"))
    return drawn.join(F.broadcast(r)).groupBy("r").agg(F.avg((F.round(F.abs("rs"), 9) >= F.round(F.abs("r"), 9)).cast("double")).alias("p"))  # one row


def permutation_baseline(df: DataFrame, key: str, x: str, y: str, reps: int, seed: int) -> DataFrame:
    """(r2, mean_r2, p): R squared of a line in x, its mean over shuffled labels, and (k + 1) / (reps + 1) for the k shuffles as good."""
    r2 = df.agg(F.regr_r2(y, x).alias("r2"))
    drawn = permuted(df, key, x, y, reps, seed).groupBy("rep").agg(F.regr_r2("y", "x").alias("rs"))
    good = F.sum((F.round("rs", 9) >= F.round("r2", 9)).cast("long"))
    return drawn.join(F.broadcast(r2)).groupBy("r2").agg(F.avg("rs").alias("mean_r2"), ((good + 1) / (F.count("*") + 1)).alias("p"))  # one row


def bootstrap_spearman(df: DataFrame, key: str, x: str, y: str, reps: int, seed: int) -> DataFrame:
    """(reps, ci_low, ci_high): rank correlations of resamples; those with two values or fewer on a side are left out. The j-th draw of a
    resample takes the row at a place hashed from seed, resample and j."""
    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"), (F.row_number().over(Window.orderBy(key)) - 1).alias("i"))
    n = own.agg(F.count("*").alias("n"))
    draws = n.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("j", F.explode(F.sequence(F.lit(1), F.col("n"))))
    at = F.conv(F.substring(md5(F.lit(seed), F.col("rep"), F.col("j")), 1, 12), 16, 10).cast("long") % F.col("n")
    rows = draws.select("rep", at.alias("i")).join(own, "i")
    rows = ranked(ranked(rows, ["rep"], "x", "rx"), ["rep"], "y", "ry")
    rho = rows.groupBy("rep").agg(F.corr("rx", "ry").alias("rho"), F.count_distinct("x").alias("dx"), F.count_distinct("y").alias("dy")).where("dx > 2 and dy > 2")
    return rho.agg(F.count("*").alias("reps"), F.percentile("rho", F.lit(0.025)).alias("ci_low"), F.percentile("rho", F.lit(0.975)).alias("ci_high"))


def kfold_line(df: DataFrame, key: str, x: str, y: str, folds: int, seed: int) -> DataFrame:
    """df with `fold`, drawn by hash, and `pred`, the line fitted to all other folds."""
    fold = F.conv(F.substring(md5(F.lit(seed), F.col(key)), 1, 8), 16, 10).cast("long") % folds
    return leave_group_out(df.withColumn("fold", fold), "fold", x, y)


def plane(df: DataFrame, keys: list[str], x1: str, x2: str, y: str) -> DataFrame:
    """Per key the least-squares plane: b0, b1, b2, from sums; null where the predictors lie on a line."""
    s11, s22, s12, s1y, s2y = F.var_pop(x1), F.var_pop(x2), F.covar_pop(x1, x2), F.covar_pop(x1, y), F.covar_pop(x2, y)
    m = df.where(F.col(x1).isNotNull() & F.col(x2).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(s11.alias("s11"), s22.alias("s22"), s12.alias("s12"), s1y.alias("s1y"), s2y.alias("s2y"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.avg(y).alias("my"))
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    b1 = F.when(det > 1e-12, (F.col("s1y") * F.col("s22") - F.col("s2y") * F.col("s12")) / det)
    b2 = F.when(det > 1e-12, (F.col("s2y") * F.col("s11") - F.col("s1y") * F.col("s12")) / det)
    return m.withColumn("b1", b1).withColumn("b2", b2).select(*keys, (F.col("my") - F.col("b1") * F.col("m1") - F.col("b2") * F.col("m2")).alias("b0"), "b1", "b2")
