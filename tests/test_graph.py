import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from perkolat.operators import graph, kernels, percolation, spatial

SCHEMA = "graph_id string, src long, dst long"


def edges(spark, pairs, name="g"):
    return graph.simple(spark.createDataFrame([(name, a, b) for a, b in pairs], SCHEMA))


def test_simple_drops_loops_and_parallels(spark):
    assert sorted(map(tuple, edges(spark, [(1, 2), (2, 1), (3, 3), (2, 3)]).select("a", "b").collect())) == [(1, 2), (2, 3)]


def test_moments_of_a_star(spark):
    m = graph.moments(graph.degrees(edges(spark, [(0, i) for i in range(1, 5)]))).first()
    assert (m["n"], m["m"], m["k1"], m["k2"]) == (5, 4, 1.6, 4.0) and math.isclose(m["cebh"], 1.6 / 2.4)


def test_empty_graph(spark):
    e = edges(spark, [])
    assert graph.moments(graph.degrees(e)).count() == 0 and graph.component_summary(e).count() == 0


def test_components_and_isolated_nodes(spark):
    e = edges(spark, [(1, 2), (2, 3), (7, 8)])
    nodes = spark.createDataFrame([("g", i) for i in (1, 2, 3, 7, 8, 9)], "graph_id string, node long")
    s = graph.component_summary(e, nodes).first()
    assert (s["n"], s["m"], s["components"], s["cyclomatic"]) == (6, 3, 3, 0) and s["lcc"] == 0.5


def test_hops_on_a_ring(spark):
    e = edges(spark, [(i, (i + 1) % 6) for i in range(6)])
    got = {r["node"]: r["hops"] for r in graph.hops(e, spark.createDataFrame([("g", 0)], "graph_id string, source long")).collect()}
    assert got == {0: 0, 1: 1, 5: 1, 2: 2, 4: 2, 3: 3}


def test_gini_against_definition(spark):
    random.seed(1)
    v = [random.randint(0, 9) for _ in range(60)]
    got = graph.gini(spark.createDataFrame([("g", x) for x in v], "graph_id string, degree long")).first()["gini"]
    want = sum(abs(a - b) for a in v for b in v) / (2 * len(v) * sum(v))
    assert math.isclose(got, want, abs_tol=1e-9)


def test_crossings_against_brute_force(spark):
    rng = np.random.default_rng(3)
    xy = rng.random((40, 2))
    pairs = {tuple(sorted(rng.choice(40, 2, replace=False).tolist())) for _ in range(60)}
    pts = spark.createDataFrame([("g", i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "graph_id string, node long, x double, y double")
    got = {(tuple(r["e"]), tuple(r["f"])) for r in spatial.crossings(spatial.chords(edges(spark, pairs), pts)).collect()}
    want = {(e, f) for e, f in itertools.combinations(sorted(pairs), 2) if not {*e} & {*f} and kernels.crosses(xy, e, f)}
    assert got == want and want


def test_touching_and_collinear_chords_do_not_cross(spark):
    pts = spark.createDataFrame([("g", i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (2.0, 0.0), (1.0, 0.0), (1.0, 1.0), (3.0, 0.0), (0.5, 0.0)])], "graph_id string, node long, x double, y double")
    assert spatial.crossings(spatial.chords(edges(spark, [(0, 1), (2, 3), (4, 5)]), pts)).count() == 0


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(5)
    xy = np.vstack([rng.random((50, 2)), rng.random((10, 2)) * 0.01, [[5.0, 5.0]]])
    pts = spark.createDataFrame([("g", i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "graph_id string, node long, x double, y double")
    got = {(r["node"], r["rank"]): r["other"] for r in spatial.knn(pts, 3).collect()}
    for i in range(len(xy)):
        d = sorted((float(np.hypot(*(xy[i] - xy[j]))), j) for j in range(len(xy)) if j != i)
        assert [got[i, k + 1] for k in range(3)] == [j for _, j in d[:3]]


@pytest.mark.parametrize("kind, pc", [("square", 0.5), ("triangular", 2 * math.sin(math.pi / 18)), ("honeycomb", 1 - 2 * math.sin(math.pi / 18))])
def test_lattice_thresholds(spark, kind, pc):
    e = graph.lattice(spark, kind, 40)
    got = percolation.threshold(percolation.curves(e, 8, percolation.grid(0.05, 0.93, 0.02), 1)).first()["pc"]
    assert abs(got - pc) < 0.06


def test_bootstrap_interval_is_ordered(spark):
    cv = percolation.curves(graph.lattice(spark, "square", 12), 6, percolation.grid(0.1, 0.9, 0.05), 1)
    b = percolation.bootstrap_threshold(cv, 6, 40, 2).first()
    assert 0.1 <= b["ci_low"] <= b["ci_high"] <= 0.9 and 0.3 < b["pc_mean"] < 0.7


def test_cut_structure():
    two = pd.DataFrame({"a": [1, 1, 2, 3, 4, 4, 5], "b": [2, 3, 3, 4, 5, 6, 6]})  # two triangles and a bridge
    s = kernels.cut_structure(two).iloc[0]
    assert (s["bridges"], s["articulation_points"]) == (1, 2) and math.isclose(s["largest_block_share"], 3 / 7)


def test_nonbacktracking_of_a_complete_graph():
    k5 = pd.DataFrame(itertools.combinations(range(5), 2), columns=["a", "b"])
    assert math.isclose(kernels.nonbacktracking(k5)["rho"][0], 3.0, rel_tol=1e-6)


@pytest.mark.parametrize("mode", ["degree", "slots", "noncross"])
def test_rewiring_keeps_degrees(mode):
    side = 8
    pts = pd.DataFrame([(j * side + i, i + 0.01 * j, j) for j in range(side) for i in range(side)], columns=["node", "x", "y"])
    grid = [(j * side + i, j * side + i + 1) for j in range(side) for i in range(side - 1)] + [(j * side + i, j * side + side + i) for j in range(side - 1) for i in range(side)]
    pdf = pd.DataFrame(grid, columns=["a", "b"])
    got, info = kernels.rewired(pdf, pts, mode, 0.2, 4)
    degree = lambda es: pd.Series([v for e in es for v in e]).value_counts().sort_index().to_dict()
    assert degree(got) == degree(grid) and len({tuple(sorted(e)) for e in got}) == len(grid)
    xy = pts[["x", "y"]].to_numpy(float)
    n = sum(kernels.crosses(xy, e, f) for e, f in itertools.combinations(got, 2) if not {*e} & {*f})
    if mode == "noncross":
        assert n == 0
    if mode == "cross":
        assert info["swaps"] > 0 and n > 0


def test_isotonic_and_ridge():
    assert kernels.isotonic(np.array([1, 2, 3.0]), np.array([1, 3, 2.0]), np.array([0, 1, 2, 9.0])).tolist() == [1, 1, 2.5, 2.5]
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3))
    y = x @ [1, -2, 0.5] + 0.01 * rng.normal(size=40)
    pred, alpha, _ = kernels.ridge_loo(x, y)
    assert np.abs(pred - y).mean() < 0.05 and alpha < 1


def test_failed_chain_is_a_row(spark):
    got = kernels.null_models(edges(spark, [(1, 2), (3, 4)]), None, "noncross", [0.5], 1, 1).select("status", "error").distinct().collect()
    assert [r["status"] for r in got] == ["fail"] and got[0]["error"]
