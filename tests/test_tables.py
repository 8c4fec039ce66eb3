import math

import pytest
from pyspark.sql import functions as F

from perkolat.functions import columns as C
from perkolat.operators import records, screening, stats


def one(spark, c, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(c.alias("x")).first()["x"]


def test_guards(spark):
    assert one(spark, C.safe_divide(F.col("a"), F.col("b")), a=1.0, b=0.0) is None
    assert one(spark, C.cebh(F.col("a"), F.col("b")), a=1.0, b=1.0) is None
    assert one(spark, C.effective_dimension(F.col("a"), F.col("b")), a=0.1, b=2.0) is None
    assert one(spark, C.finite(F.col("a")), a=float("nan")) is None


def test_great_circle(spark):
    quarter = one(spark, C.great_circle_m(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(0.0)))
    assert math.isclose(quarter, math.pi / 2 * C.EARTH_M, rel_tol=1e-12)


def test_names(spark):
    assert one(spark, C.normalised_name(F.col("a")), a="São Paulo (City), Área") == "sao paulo"
    assert one(spark, C.slug(F.col("a")), a="  New York--US ") == "new_york_us"
    assert [one(spark, C.truthy_tag(F.col("a")), a=v) for v in ("yes", " No ", "0", "viaduct")] == [True, False, False, True]


def test_mean_ci_of_one_and_none(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", float("nan")), ("c", 1.0), ("c", 3.0)], "k string, v double")
    got = {r["k"]: r for r in df.groupBy("k").agg(*C.mean_ci(F.col("v"))).collect()}
    assert got["a"]["ci_low"] == 2.0 and got["b"]["mean"] is None and math.isclose(got["c"]["ci_high"], 2 + 1.96)


def test_kendall_and_ranks(spark):
    df = spark.createDataFrame([("g", 1, 1), ("g", 2, 3), ("g", 3, 2), ("g", 3, 4)], "k string, x int, y int")
    assert math.isclose(stats.kendall(df, ["k"], "x", "y").first()["tau"], 3 / math.sqrt(5 * 6))
    ranks = sorted(r["r"] for r in stats.ranked(df, ["k"], "x", "r").collect())
    assert ranks == [1.0, 2.0, 3.5, 3.5]


def test_records(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y"), (None, "z")], "k int, v string")
    assert sorted(r["v"] for r in records.append_unique(old, new, ["k"]).collect()) == ["a", "b", "n", "y"]
    up = {r["k"]: r["v"] for r in records.upsert(old.where("k > 0"), new.where("k > 0"), "k", ["v"]).collect()}
    assert up == {1: "a", 2: "x", 3: "y"}
    f = records.feature_list(spark.createDataFrame([(1, "a; b;;a ;c")], "k int, f string"), ["k"], "f").orderBy("place").collect()
    assert [(r["place"], r["feature"]) for r in f] == [(1, "a"), (2, "b"), (3, "c")]


def test_flips_at_ties(spark):
    nets = spark.createDataFrame([("c", "d", 0.5, 0.4, 0.5)], "city string, domain string, pc_obs double, pc_cebh double, pc_derived double")
    assert not screening.flips(nets, 0.5).first()["flip"]  # an observed loss of exactly phi passes
    s = screening.sign_mismatch(nets, 0.5).first()
    assert (s["cebh"], s["derived"]) == (1.0, 0.0)
    assert {r["flip_rate"] for r in screening.sweep(nets, 50, 50).collect()} == {0.0}


@pytest.mark.parametrize("rebinned, zero", [(False, False), (True, True)])
def test_length_bin_distance(spark, rebinned, zero):
    df = spark.createDataFrame([("a", float(i)) for i in range(80)] + [("b", float(i * 3)) for i in range(80)], "g string, v double")
    tvd = stats.length_bin_tvd(df, "g", "v", "a", "b", rebinned=rebinned).first()["tvd"]
    assert (abs(tvd) < 1e-9) == zero
