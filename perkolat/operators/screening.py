"""Decision screening over networks(city, domain, pc_obs, pc_cebh, pc_derived): tolerable loss, flips, sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREDICTORS = ("cebh", "derived")


def tolerable_loss(nets: DataFrame) -> DataFrame:
    """f_c = 1 - p_c for each estimate, and how much the degree-moment threshold overrates it."""
    out = nets
    for p in ("obs", *PREDICTORS):
        out = out.withColumn(f"fc_{p}", 1 - F.col(f"pc_{p}"))
    return out.withColumn("overrating", F.col("fc_cebh") - F.col("fc_obs"))


def flips(nets: DataFrame, phi: float) -> DataFrame:
    """Margins at a required loss phi; flip: the degree-moment estimate passes, the observed one does not."""
    f = tolerable_loss(nets)
    return f.select("city", "domain", *[(F.col(f"fc_{p}") - phi).alias(f"margin_{p}") for p in ("obs", *PREDICTORS)], ((F.col("fc_cebh") >= phi) & (F.col("fc_obs") < phi)).alias("flip"))


def sweep(nets: DataFrame, lo: int, hi: int) -> DataFrame:
    """Per threshold (whole percents lo to hi), domain and predictor: networks and the share whose signs differ strictly."""
    f = tolerable_loss(nets).select("city", "domain", "fc_obs", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("percent"), *[f"fc_{p}" for p in PREDICTORS])
    parts = F.array(*[F.struct(F.lit(p).alias("predictor"), F.col(f"fc_{p}").alias("fc")) for p in PREDICTORS])
    long = f.select("percent", "domain", "fc_obs", F.inline(parts))
    phi = F.col("percent") / 100
    flip = (F.col("fc") - phi) * (F.col("fc_obs") - phi) < 0
    return long.groupBy("percent", "domain", "predictor").agg(F.count("*").alias("n"), F.avg(flip.cast("double")).alias("flip_rate"))


def band(swept: DataFrame) -> DataFrame:
    return swept.groupBy("domain", "predictor").agg(F.min("flip_rate").alias("low"), F.avg("flip_rate").alias("mean"), F.max("flip_rate").alias("high"))


def sign_mismatch(nets: DataFrame, phi: float) -> DataFrame:
    """Shares of networks whose margins differ in sign, a margin of zero being a sign of its own."""
    f = tolerable_loss(nets)
    return f.groupBy("domain").agg(*[F.avg((F.signum(F.col(f"fc_{p}") - phi) != F.signum(F.col("fc_obs") - phi)).cast("double")).alias(p) for p in PREDICTORS])


def errors(nets: DataFrame) -> DataFrame:
    """Mean absolute error and bias of each predictor by domain, each against the same observed threshold."""
    e = lambda p: F.col(f"pc_{p}") - F.col("pc_obs")
    return nets.groupBy("domain").agg(F.count("*").alias("n"), *[f(p) for p in PREDICTORS for f in (lambda p: F.avg(F.abs(e(p))).alias(f"mae_{p}"), lambda p: F.avg(e(p)).alias(f"bias_{p}"))])
