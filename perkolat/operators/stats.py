"""Statistics over long tables: correlations, ranks, distances between distributions, resampling by hash."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perkolat.functions.columns import finite
from perkolat.lineage import small, written


def ranked(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """df with the average-tie rank of a value within its group; null has none."""
    w, ties = Window.partitionBy(*group).orderBy(F.col(value).asc_nulls_last()), Window.partitionBy(*group, value)
    return df.withColumn(name, F.when(F.col(value).isNotNull(), F.rank().over(w) + (F.count("*").over(ties) - 1) / 2))


def pearson(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    both = df.withColumn(x, finite(F.col(x))).withColumn(y, finite(F.col(y))).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*group).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"))


def spearman(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    both = df.where(finite(F.col(x)).isNotNull() & finite(F.col(y)).isNotNull())
    r = ranked(ranked(both, group, x, "_rx"), group, y, "_ry")
    return r.groupBy(*group).agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("rho"))


def beta_ratio(x: np.ndarray, a: np.ndarray, b: float, rounds: int = 100_000) -> np.ndarray:
    """The regularised incomplete beta function I_x(a, b) by its continued fraction, in the half where that converges fast."""
    flip = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    tiny, one = 1e-300, np.ones_like(x)
    d = 1 / np.where((v := 1 - (a + b) * x / (a + 1)) == 0, tiny, v)
    c, f = one, d
    for m in range(1, rounds + 1):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / np.where((v := 1 + num * d) == 0, tiny, v)
            c = np.where((v := 1 + num / c) == 0, tiny, v)
            f = f * c * d
        if np.all(np.abs(c * d - 1) < 1e-14):
            break
    else:
        raise RuntimeError("the continued fraction does not converge")
    log = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(log(a + b) - log(a) - log(b) + a * np.log(x) + b * np.log1p(-x)) / a
    out = np.where(x <= 0, 0.0, front * f)
    return np.where(flip, 1 - out, out)


def correlation_p(df: DataFrame, r: str, n: str = "n", name: str = "p") -> DataFrame:
    """df with the two-sided p of each correlation by Student's t of n - 2 degrees of freedom; null for fewer than 3 points or no correlation.
    df is one row a group, so the fraction is taken in Arrow batches of aggregates, not of data."""

    @F.pandas_udf("double")
    def of(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(beta_ratio(np.clip(1 - r.to_numpy() ** 2, 0, 1), (n.to_numpy() - 2) / 2, 0.5))

    there = F.col(r).isNotNull() & (F.col(n) > 2)
    safe = of(F.when(there, F.col(r)).otherwise(F.lit(0.0)), F.when(there, F.col(n)).otherwise(F.lit(3)).cast("double"))
    return df.withColumn(name, F.when(there, safe))


def kendall(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Kendall's tau-b from counts of distinct (x, y): pairs are made of distinct points with their multiplicities."""
    h = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*group, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("c"))
    a, b = h.alias("a"), h.alias("b")
    on = [F.col(f"a.{g}") == F.col(f"b.{g}") for g in group] + [(F.col("a.x") < F.col("b.x"))]
    sign = F.signum(F.col("b.y") - F.col("a.y"))
    s = a.join(b, on).groupBy(*[F.col(f"a.{g}").alias(g) for g in group]).agg(F.sum(sign * F.col("a.c") * F.col("b.c")).alias("s"))
    pairs = lambda c: c * (c - 1) / 2
    n0 = h.groupBy(*group).agg(pairs(F.sum("c")).alias("n0"), F.sum("c").alias("n"))
    tx = h.groupBy(*group, "x").agg(F.sum("c").alias("c")).groupBy(*group).agg(F.sum(pairs(F.col("c"))).alias("tx"))
    ty = h.groupBy(*group, "y").agg(F.sum("c").alias("c")).groupBy(*group).agg(F.sum(pairs(F.col("c"))).alias("ty"))
    j = n0.join(tx, group).join(ty, group).join(s, group, "left").na.fill(0, ["s"])
    den = F.sqrt((F.col("n0") - F.col("tx")) * (F.col("n0") - F.col("ty")))
    return j.select(*group, "n", F.when(den > 0, F.col("s") / den).alias("tau"))


def partial_spearman(df: DataFrame, group: list[str], x: str, y: str, control: str) -> DataFrame:
    """Correlation of the ranks of x and y after a line in the control's rank is taken from both."""
    r = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(control).isNotNull())
    for c, name in ((x, "_rx"), (y, "_ry"), (control, "_rz")):
        r = ranked(r, group, c, name)
    g = r.groupBy(*group).agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("xy"), F.corr("_rx", "_rz").alias("xz"), F.corr("_ry", "_rz").alias("yz"))
    den = F.sqrt((1 - F.pow("xz", F.lit(2))) * (1 - F.pow("yz", F.lit(2))))
    return g.select(*group, "n", F.when(den > 0, (F.col("xy") - F.col("xz") * F.col("yz")) / den).alias("rho"))


def ols(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*group).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def fit_metrics(df: DataFrame, group: list[str], truth: str, pred: str) -> DataFrame:
    e = F.col(pred) - F.col(truth)
    return df.groupBy(*group).agg((1 - F.try_divide(F.sum(e * e), F.var_pop(truth) * F.count(truth))).alias("r2"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))


def leave_group_out(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """df with `pred`: the line fitted to all other groups. Sums of each group are taken from the sums of all; rows shuffle once."""
    X, Y = F.col(x), F.col(y)
    sums = df.groupBy(group).agg(F.count("*").alias("n"), F.sum(X).alias("sx"), F.sum(Y).alias("sy"), F.sum(X * X).alias("sxx"), F.sum(X * Y).alias("sxy"))
    every = Window.partitionBy()
    for c in ("n", "sx", "sy", "sxx", "sxy"):  # one row for each group
        sums = sums.withColumn(f"o{c}", F.sum(c).over(every) - F.col(c))
    slope = F.try_divide(F.col("on") * F.col("osxy") - F.col("osx") * F.col("osy"), F.col("on") * F.col("osxx") - F.col("osx") * F.col("osx"))
    fit = sums.select(group, slope.alias("slope"), F.try_divide(F.col("osy") - slope * F.col("osx"), F.col("on")).alias("intercept"))
    return df.join(fit, group).withColumn("pred", F.col("slope") * X + F.col("intercept"))


def quartile_bands(df: DataFrame, value: str) -> DataFrame:
    """df with band 1 to 4: right-closed quartiles by linear interpolation, the lowest value included."""
    q = df.agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    v = F.col(value)
    out = df.join(F.broadcast(q))  # one row
    return out.withColumn("band", F.when(v <= F.col("q")[0], 1).when(v <= F.col("q")[1], 2).when(v <= F.col("q")[2], 3).when(v.isNotNull(), 4)).drop("q")


def z_index(df: DataFrame, plus: list[str], minus: list[str]) -> Column:
    """df with `index`: mean z-score of the plus columns less that of the minus ones; null counts as the mean, no spread as 0."""
    one = df.agg(*[f(c).alias(f"{n}_{c}") for c in plus + minus for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    j = df.join(F.broadcast(one))  # one row
    z = lambda c: F.when(F.col(f"s_{c}") > 0, (F.coalesce(F.col(c), F.col(f"m_{c}")) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0)
    mean = lambda cs: sum((z(c) for c in cs), F.lit(0.0)) / max(len(cs), 1)
    return j.withColumn("index", mean(plus) - mean(minus)).select(*df.columns, "index")


def ks(df: DataFrame, group: str, value: str, one: str, two: str) -> DataFrame:
    """The largest distance between the distribution functions of two groups' values, from counts by value."""
    h = df.where(F.col(group).isin(one, two) & F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(group) == one).alias("a"), F.count_if(F.col(group) == two).alias("b"))
    up, every = Window.orderBy("v"), Window.partitionBy()
    d = F.abs(F.try_divide(F.sum("a").over(up), F.sum("a").over(every)) - F.try_divide(F.sum("b").over(up), F.sum("b").over(every)))
    return h.select(d.alias("d")).agg(F.max("d").alias("ks"))


def length_bin_tvd(df: DataFrame, group: str, value: str, base: str, other: str, bins: int = 8, rebinned: bool = False) -> DataFrame:
    """Total variation between two groups' bins. Bins are quantiles of the base group's values; rebinned: of each group's own,
    which makes the distance vanish by construction and is kept for comparison only. Values beyond the edges go to the end bins."""
    at = [i / bins for i in range(1, bins)]
    own = df.where(F.col(group).isin(base, other) & F.col(value).isNotNull())
    q = own.groupBy(group).agg(F.percentile(value, F.array(*map(F.lit, at))).alias("q"))
    q = q if rebinned else q.where(F.col(group) == base).select("q")
    own = own.join(F.broadcast(q), group) if rebinned else own.join(F.broadcast(q))  # one or two rows
    binned = own.withColumn("bin", F.size(F.filter("q", lambda e: e <= F.col(value))))
    n = binned.groupBy("bin").agg(F.count_if(F.col(group) == base).alias("a"), F.count_if(F.col(group) == other).alias("b"))
    every = Window.partitionBy()
    return n.select(F.abs(F.try_divide(F.col("a"), F.sum("a").over(every)) - F.try_divide(F.col("b"), F.sum("b").over(every))).alias("d")).agg((F.sum("d") / 2).alias("tvd"))


#: Draws of a run, which is one row until they are made; values of a group in one array; most arrays that are broadcast.
DRAWS, SLICE, MAX_ARRAYS = 50_000, 4096, 1000


def draws(size: DataFrame, group: list[str], reps: int, seed: int) -> DataFrame:
    """(group, rep, i): the places that each of `reps` resamples draws from the n places of each group of size(group, n), spread over tasks."""
    runs = size.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(DRAWS).cast("long"))))
    runs = written(runs, "boot-runs")
    # By a round robin, as a hash would leave some tasks several runs; about forty runs a task once there are many.
    runs = runs.repartition(max(size.sparkSession.sparkContext.defaultParallelism, runs.count() // 40))
    made = runs.withColumn("j", F.explode(F.sequence(F.col("at") + 1, F.least(F.col("at") + DRAWS, F.col("n")))))
    hex_ = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *group, F.col("rep").cast("string"), F.col("j").cast("string"))), 1, 12)
    return made.select(*group, "rep", (F.conv(hex_, 16, 10).cast("long") % F.col("n")).alias("i"))


def bootstrap_mean(df: DataFrame, group: list[str], value: str, key: str, reps: int, seed: int) -> DataFrame:
    """Per group the mean and the 2.5 and 97.5 percentiles of the means of `reps` resamples. The j-th draw of a resample takes the
    row at a place hashed from seed, group, resample and j, so that any engine draws the same rows.

    Draws are dealt out in runs of DRAWS, made where they are summed, and find their value in arrays of SLICE values of the group, in the
    order of the key: by a broadcast if there are few arrays, else by a join on the arrays' numbers."""
    w = Window.partitionBy(*group).orderBy(key)
    own = df.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("v"), (F.row_number().over(w) - 1).cast("long").alias("i"))
    own = own.withColumn("part", F.floor(F.col("i") / SLICE))
    arrays = written(own.groupBy(*group, "part").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("r")).select(*group, "part", F.col("r.v").alias("vs")), "boot-values")
    size = arrays.groupBy(*group).agg(F.sum(F.size("vs")).alias("n"))
    made = draws(size, group, reps, seed).withColumn("part", F.floor(F.col("i") / SLICE))
    drawn = made.join(small(arrays, MAX_ARRAYS), [*group, "part"]).select(*group, "rep", F.get("vs", (F.col("i") % SLICE).cast("int")).alias("v"))
    means = drawn.groupBy(*group, "rep").agg(F.avg("v").alias("mean"))
    out = means.groupBy(*group).agg(F.percentile("mean", F.lit(0.025)).alias("ci_low"), F.percentile("mean", F.lit(0.975)).alias("ci_high"))
    return own.groupBy(*group).agg(F.avg("v").alias("mean")).join(out, group)
