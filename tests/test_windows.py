"""Sinks, discs, fine thresholds and p-values on small inputs."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from perkolat.operators import percolation, spatial, stats
from perkolat.sources import tables


def test_csv_sink_rounds_and_leaves_out_what_is_not_finite(spark, tmp_path):
    df = spark.createDataFrame([("a", 1 / 3, 1), ("b", math.nan, 2), ("c", math.inf, None)], "k string, v double, n int")
    tables.write_csv(df, str(tmp_path / "o"))
    got = tables.read_csv(spark, str(tmp_path / "o"), {"k": "string", "v": "double", "n": "int"})
    assert sorted(map(tuple, got.collect())) == [("a", 0.333333, 1), ("b", None, 2), ("c", None, None)]


def test_json_sink_keeps_nulls_and_fails_on_nan(spark, tmp_path):
    kind = "k string, v double, w array<struct<x: double>>"
    tables.write_json(spark.createDataFrame([("a", None, [(1.5,), (None,)])], kind), str(tmp_path / "o"))
    lines = [json.loads(x) for f in (tmp_path / "o").glob("*.json") for x in f.read_text().splitlines()]
    assert lines == [{"k": "a", "v": None, "w": [{"x": 1.5}, {"x": None}]}]
    for k, row in enumerate([("a", math.nan, []), ("b", 1.0, [(math.inf,)])]):
        with pytest.raises(Exception, match="not finite"):
            tables.write_json(spark.createDataFrame([row], kind), str(tmp_path / f"bad{k}"))


def test_disc_keeps_the_largest_component_within(spark):
    lon = {1: 10.0, 2: 10.01, 3: 10.02, 4: 10.2, 5: 9.99, 6: 9.98}  # a degree is some 55.7 km at 60 north
    points = spark.createDataFrame([("g", k, x, 60.0) for k, x in lon.items()], "graph_id string, node long, x double, y double")
    edges = spark.createDataFrame([("g", 1, 2), ("g", 2, 3), ("g", 3, 4), ("g", 5, 6), ("h", 1, 2)], "graph_id string, a long, b long")
    centres = spark.createDataFrame([("g", 10.0, 60.0)], "graph_id string, lon double, lat double")
    got = spatial.disc(edges, points, centres, 1200.0).select("graph_id", "a", "b").collect()
    assert sorted(map(tuple, got)) == [("g", 1, 2), ("g", 2, 3)]
    assert spatial.disc(edges, points, centres, 0.1).count() == 0


def test_fine_threshold_equals_a_slow_reckoning(spark):
    side = 8
    pairs = [(x * side + y, x * side + y + s) for x in range(side) for y in range(side) for s, ok in ((1, y + 1 < side), (side, x + 1 < side)) if ok]
    edges = spark.createDataFrame([("g", a, b) for a, b in pairs], "graph_id string, a long, b long")
    got = percolation.fine_threshold(edges, 3, (4, percolation.grid(0.05, 0.93, 0.02)), perms=6, reps=20).first()
    grid = percolation.fine_grid(got["pc_coarse"], 0.06, 0.005)
    assert len(grid) == 25 and abs(grid[0] - got["pc_coarse"] + 0.06) < 1e-9
    order = edges.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(6)))).withColumn("h", percolation.hashed(F.lit(4), F.col("perm"), F.col("a"), F.col("b"))).toPandas()

    def share(e):
        group = {k: {k} for k in range(side * side)}
        for a, b in e:
            if group[a] is not group[b]:
                group[a] |= group[b]
                for k in group[b]:
                    group[k] = group[a]
        return max(map(len, group.values())) / side**2

    curves = []
    for _, own in order.groupby("perm"):
        e = own.sort_values(["h", "a", "b"])[["a", "b"]].to_numpy().tolist()
        curves.append([share(e[: int(np.rint(p * len(e)))]) for p in grid])
    assert got["pc"] == grid[int(np.argmax(np.round(np.gradient(np.mean(curves, axis=0), grid), 12)))]
    assert grid[0] <= got["ci_low"] <= got["pc_mean"] <= got["ci_high"] <= grid[-1]


def test_fine_grid_stays_within_its_bounds():
    assert percolation.fine_grid(0.05, 0.06, 0.005)[0] == 0.03 and percolation.fine_grid(0.93, 0.06, 0.005)[-1] == 0.97


def test_correlation_p_against_closed_forms(spark):
    closed = {3: lambda r: 1 - 2 / math.pi * math.asin(r), 4: lambda r: 1 - r, 6: lambda r: 1 - (3 * r - r**3) / 2}
    rows = [(n, s * r) for n in closed for r in (0.0, 0.1, 0.6, 0.99, 1.0) for s in (1.0, -1.0)]
    df = spark.createDataFrame([*rows, (2, 1.0), (9, None)], "n long, r double")
    got = stats.correlation_p(df, "r").toPandas()
    for n, r, p in got.itertuples(index=False):
        assert pd.isna(p) if n == 2 or pd.isna(r) else p == pytest.approx(closed[n](abs(r)), abs=1e-12)
    many = stats.correlation_p(spark.createDataFrame([(1_000_000, 0.00196)], "n long, r double"), "r").first()["p"]
    assert many == pytest.approx(math.erfc(1.96 / math.sqrt(2)), abs=1e-5)
