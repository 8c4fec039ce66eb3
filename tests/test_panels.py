"""Panels, guards, matching, dials and the mended spatial operators on small inputs."""

import random
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from perkolat.functions import columns as C
from perkolat.lineage import shared_dir
from perkolat.operators import dials, graph, kernels, matching, panels, resampling, spatial


def test_many_to_one_refuses_repeated_keys(spark):
    left, right = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    assert sorted((r["k"] or 0, r["v"]) for r in panels.many_to_one(left, right, ["k"]).collect()) == [(0, None), (1, "a"), (2, None)]
    with pytest.raises(ValueError):
        panels.many_to_one(left, right.unionByName(right), ["k"])


def test_guards():
    panels.leakage_guard(["a", "b"], ["c"])
    with pytest.raises(ValueError):
        panels.leakage_guard(["a", "b"], ["b"])


def test_assert_distinct(spark):
    df = spark.range(5)
    assert panels.assert_distinct(df, "id", 5).count() == 5
    with pytest.raises(ValueError):
        panels.assert_distinct(df, "id", 4)


def test_paired_and_first_present_need_values(spark):
    df = spark.createDataFrame([(1, "a", 2.0, 1), (1, "b", None, 2), (2, "a", None, 1), (2, "a", 3.0, 2), (2, "b", 1.0, 3)], "k int, side string, v double, t int")
    assert [tuple(r) for r in panels.paired(df, ["k"], "side", "a", "b", "v").collect()] == [(2, 3.0, 1.0, 2.0)]
    assert sorted(tuple(r) for r in panels.first_present(df, ["k"], F.col("t"), ["v"]).collect()) == [(1, 2.0), (2, 3.0)]


def test_names_and_seeds(spark):
    df = spark.createDataFrame([("Greater São Paulo (City)",), ("Łódź-Prefecture of İzmir",), (None,), ("",), ("a" * 100_000,)], "n string")
    got = [(r[0], r[1]) for r in df.select(C.normalised_name(F.col("n")), C.position_seed(F.col("n"))).collect()]
    assert got[0][0] == "sao paulo" and got[1][0].endswith("of izmir") and got[2] == (None, None) and got[3] == ("", 0)
    assert got[4][1] == 97 * 100_000 * 100_001 // 2


def test_clips_and_logs(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (100.0,), (None,)], "v double")
    assert [tuple(r) for r in df.select(C.log10_positive(F.col("v")), C.clipped(F.col("v"), 0.0, 50.0)).collect()] == [(None, 0.0), (None, 0.0), (2.0, 50.0), (None, None)]


def test_nearest_with_null_points(spark):
    pts = spark.createDataFrame([("g", 1, 0.0, 0.0), ("g", 2, 1.0, None), ("g", 3, 1.0, 1.0), ("h", 4, 0.0, 0.0)], "graph_id string, node long, x double, y double")
    assert sorted((r["node"], r["other"]) for r in spatial.knn(pts, 1).collect()) == [(1, 3), (3, 1)]


def test_pruning_where_the_median_length_is_zero(spark):
    pts = spark.createDataFrame([("g", i, x, y) for i, x, y in ((1, 0.0, 0.0), (2, 1.0, 1.0), (3, 0.5, 0.5), (4, 0.0, 0.0), (5, 9.0, 9.0), (6, 9.0, 9.0))], "graph_id string, node long, x double, y double")
    edges = spark.createDataFrame([("g", 1, 2), ("g", 1, 4), ("g", 5, 6)], "graph_id string, a long, b long")
    for rule in ("gabriel", "rng"):
        assert sorted((r["a"], r["b"]) for r in spatial.pruned(spatial.chords(edges, pts), pts, rule).collect()) == [(1, 4), (5, 6)]


def test_one_long_edge_among_short_ones(spark):
    rng = random.Random(1)
    xy = [(rng.random(), rng.random()) for _ in range(40)] + [(5000.0, 5000.0)]
    pts = spark.createDataFrame([("g", i, x, y) for i, (x, y) in enumerate(xy)], "graph_id string, node long, x double, y double")
    pairs = [(i, i + 1) for i in range(40)]
    edges = spark.createDataFrame([("g", a, b) for a, b in pairs], "graph_id string, a long, b long")
    d2 = lambda p, q: (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2
    want = sorted((a, b) for a, b in pairs if not any(d2(xy[a], p) + d2(xy[b], p) < d2(xy[a], xy[b]) for i, p in enumerate(xy) if i not in (a, b)))
    assert sorted((r["a"], r["b"]) for r in spatial.pruned(spatial.chords(edges, pts), pts, "gabriel").collect()) == want


def test_crossings_of_chords_where_most_have_no_length(spark):
    rows = [("g", 1, 2, 0.0, 0.0, 1.0, 1.0), ("g", 3, 4, 0.0, 1.0, 1.0, 0.0), ("g", 5, 6, 3.0, 3.0, 3.0, 3.0), ("g", 7, 8, 4.0, 4.0, 4.0, 4.0), ("g", 9, 10, 5.0, 5.0, 5.0, 5.0)]
    assert spatial.crossings(spark.createDataFrame(rows, "graph_id string, a long, b long, ax double, ay double, bx double, by double")).count() == 1


def test_numbers_within_groups(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), "id", F.md5(F.col("id").cast("string")).alias("h"))
    got = graph.numbered(df, ["g"], "h", ["id"]).toPandas()
    for _, part in got.groupby("g"):
        assert part.sort_values(["h", "id"])["r"].tolist() == list(range(len(part)))


def test_vertex_split_keeps_neighbours(spark):
    e = graph.lattice(spark, "square", 8)
    out = graph.vertex_split(e, 40, 1)
    deg = {r["node"]: r["degree"] for r in graph.degrees(out).collect()}
    new = [n for n in deg if n < 0]
    assert new and all(deg[n] == 3 and deg[-1 - n] == 3 for n in new) and out.count() == 128 + len(new)


def test_similarity_is_that_of_the_matcher(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choice("abcd ") for _ in range(rng.randrange(12))), "".join(rng.choice("abcd ") for _ in range(rng.randrange(12)))) for _ in range(50)] + [(None, "a"), (None, None)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", matching.ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(r["r"] == SequenceMatcher(None, r["a"] or "", r["b"] or "").ratio() for r in got)


def test_name_match_prefers_near_and_keeps_the_unmatched(spark):
    schema = "{} long, block string, name string, lon double, lat double"
    places = spark.createDataFrame([(1, "x", "Old Town City", 0.0, 0.0), (2, "y", "Alone", 0.0, 0.0)], schema.format("id"))
    centres = spark.createDataFrame([(7, "x", "Old Town", 9.0, 9.0), (8, "x", "Óld Town", 0.1, 0.0), (9, "z", "Alone", 0.0, 0.0)], schema.format("centre"))
    got = {r["id"]: (r["centre"], r["status"]) for r in matching.blocked_name_match(places, centres).collect()}
    assert got == {1: (8, "high_confidence"), 2: (None, "no_candidate")}


def frame(n, seed):
    rng = random.Random(seed)
    xy = {i: (rng.random(), rng.random()) for i in range(n)}
    edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(2 * n)}
    return pd.DataFrame([(a, b, *xy[a], *xy[b]) for a, b in sorted(edges)], columns=["a", "b", "ax", "ay", "bx", "by"])


@pytest.mark.parametrize("arm", ["cross", "noncross"])
def test_dials_keep_degrees(arm):
    pdf = frame(60, 3)
    for out in dials.matched(pdf, arm, [0.02, 0.05], 5):
        for side in (pd.concat([pdf["a"], pdf["b"]]), ):
            assert side.value_counts().sort_index().equals(pd.concat([out["a"], out["b"]]).value_counts().sort_index())
        assert not out[["a", "b"]].duplicated().any() and (out["a"] != out["b"]).all()


def test_localisation_of_a_cycle_is_even():
    n = 10
    out = kernels.nonbacktracking(pd.DataFrame({"a": range(n), "b": [(i + 1) % n for i in range(n)]})).iloc[0]
    assert abs(out["rho"] - 1) < 1e-9 and abs(out["ipr"] - 1 / 20) < 1e-9 and abs(out["top1"] - 1 / 20) < 1e-9 and abs(out["node_entropy"] - 1) < 1e-9


def test_even_spread_of_a_bipartite_star():
    out = kernels.nonbacktracking(pd.DataFrame({"a": [0, 0, 0, 1, 2], "b": [1, 2, 3, 4, 4]})).iloc[0]
    assert out["node_top1"] <= 1 and out["p_nb"] > 0


def test_permutation_p_of_noise_and_of_a_line(spark):
    df = spark.range(30).select("id", F.col("id").cast("double").alias("x"), (2.0 * F.col("id")).alias("y"))
    assert resampling.permutation_p(df, "id", "x", "y", 50, 1).first()["p"] == 0


def test_a_shared_folder_is_asked_for(spark):
    assert shared_dir(spark)
