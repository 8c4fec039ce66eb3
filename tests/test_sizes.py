"""Shapes that only larger tables have: long paths, many draws, large blocks, long chords."""

import random
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from perkolat.operators import dials, kernels, matching, stats


def against_sql(spark, name, folder, **tables):
    """The query's rows and its SQL's over the given tables, sorted."""
    c = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got = entry.queries()[name](spark, str(folder))
    want = c.execute(entry.oracle_sql()[name]).df()[got.columns]
    return sorted(map(tuple, got.collect())), sorted(want.itertuples(index=False, name=None))


def test_path_pairs_beyond_the_limit_have_no_row(spark, tmp_path):
    line = spark.range(150).selectExpr("id AS vec_id", "array(float(id), float(0)) AS embedding")
    got, want = against_sql(spark, "path_pairs", tmp_path, embeddings=line)
    assert got == want and 0 < len(got) < 29 and max(r[3] for r in got) <= 60


def test_draws_are_made_in_many_tasks(spark):
    made = stats.draws(spark.createDataFrame([("a", 30_000), ("b", 1)], "g string, n long"), ["g"], 8, 9)
    each = made.groupBy("g", "rep").count().toPandas()
    assert made.rdd.getNumPartitions() >= 4 and set(map(tuple, each[["g", "count"]].to_numpy())) == {("a", 30_000), ("b", 1)} and len(each) == 16


@pytest.mark.parametrize("arrays", [0, 1000], ids=["joined", "broadcast"])
def test_bootstrap_over_runs_and_arrays_equals_its_sql(spark, tmp_path, monkeypatch, arrays):
    for name, n in (("DRAWS", 7), ("SLICE", 4), ("MAX_ARRAYS", arrays)):
        monkeypatch.setattr(stats, name, n)
    rows = spark.range(45).selectExpr("id AS c_custkey", "cast(id % 7 * 1.5 AS double) AS c_acctbal", "if(id < 40, 'long', 'short') AS c_mktsegment")
    got, want = against_sql(spark, "bootstrap_mean_ci", tmp_path, customer=rows)
    assert got == want and len(got) == 2


def chords(n, seed):
    """Points, and short and long chords between them, some upright, some flat, some on lines of the grid."""
    rng = np.random.default_rng(seed)
    xy = np.concatenate([rng.random((n, 2)) * 10 - 5, rng.integers(-5, 6, (n, 2))])
    near = ((xy[:, None] - xy[None]) ** 2).sum(axis=2).argsort(axis=1)[:, 1:3]
    short = {(min(i, int(j)), max(i, int(j))) for i in range(2 * n) for j in near[i]}
    far = {tuple(sorted(e)) for e in rng.integers(0, 2 * n, (n, 2)).tolist() if e[0] != e[1]}
    return xy, sorted(short | far)


def test_a_long_chord_covers_the_cells_along_it_alone():
    xy = np.array([*[(i, i % 2) for i in range(201)], (0.3, 200.7)], float)
    grid = kernels.ChordGrid(xy, [(i, i + 1) for i in range(200)])
    assert len(list(grid.cover((200, 201)))) < 4 * 200 / grid.cell < (200 / grid.cell) ** 2


@pytest.mark.parametrize("test", [kernels.crosses, kernels.meets])
def test_chords_met_along_cells_are_those_of_all_pairs(test):
    xy, edges = chords(60, 4)
    grid, skip = kernels.ChordGrid(xy, edges), edges[3:5]
    for e in edges:
        want = sum(test(xy, e, f) for f in edges if not {*e} & {*f} and f not in skip)
        assert grid.crossed(e, test=test, skip=skip) == want and grid.crossed(e, 2, test, skip) == min(2, want)


def test_the_matched_dial_looks_no_further_than_the_first_crossing(monkeypatch):
    xy, edges = chords(150, 5)
    pdf, calls, real = pd.DataFrame([(a, b, *xy[a], *xy[b]) for a, b in edges], columns=["a", "b", "ax", "ay", "bx", "by"]), [0], kernels.crosses

    def counted(*args):
        calls[0] += 1
        return real(*args)

    monkeypatch.setattr(kernels, "crosses", counted)
    dials.matched(pdf, "noncross", [0.02], 5)
    assert calls[0] < 40 * 400 * round(0.02 * len(edges))  # forty for each try at most; all chords of the box were met before


def test_partners_are_drawn_among_the_nearest_also_after_moves():
    rng = np.random.default_rng(6)
    p = np.concatenate([rng.normal(size=(400, 2)), rng.normal(size=(30, 2)) * 40])
    own = kernels.Nearest(p.copy(), 25, 400.0)
    for k in range(60):
        own.move(int(rng.integers(len(p))), rng.normal(size=2) * 60)
        i, rank = int(rng.integers(len(p))), int(rng.integers(25))
        far = ((own.points - own.points[i]) ** 2).sum(axis=1)
        assert far[own.of(i, rank)] == np.sort(far)[rank]


def places_and_centres():
    """Names of a small alphabet, alike, empty, null and long, at places near and far, unknown, and the same."""
    rng = random.Random(7)
    name = lambda: rng.choice([None, "", "ab" * 140, "é" * 70 + "x"]) if rng.random() < 0.1 else "".join(rng.choice("abc 12") for _ in range(rng.randrange(1, 14)))
    at = lambda: rng.choice([None, float("nan")]) if rng.random() < 0.1 else rng.choice([0.0, 0.5, 1.5, 60.0]) + rng.choice([0.0, 0.01])
    row = lambda i: (i, rng.choice(["x", "x", "y", None]), name(), at(), at())
    return [row(i // 2) for i in range(120)] + [(900, "z", "alone", 0.0, 0.0)], [row(i // 2) for i in range(90)] + [(None, "x", "abc", 0.0, 0.0)]


def every_pair(places, centres):
    """The match that compares all pairs of a block."""
    km = matching.great_circle_m(*map(F.col, ("p_lon", "p_lat", "c_lon", "c_lat"))) / 1000
    p = places.selectExpr("id", "block", "name AS p_name", "lon AS p_lon", "lat AS p_lat").withColumn("p_name", matching.normalised_name(F.col("p_name")))
    c = centres.selectExpr("centre", "block", "name AS c_name", "lon AS c_lon", "lat AS c_lat").withColumn("c_name", matching.normalised_name(F.col("c_name")))
    met = p.join(c, "block").withColumn("s", matching.ratio(F.col("p_name"), F.col("c_name"))).withColumn("km", km)
    score = F.round(F.col("s") - F.least("km", F.lit(300.0)) / 1000, 12)
    best = met.groupBy("id").agg(F.max(F.struct(score.alias("score"), (-F.col("centre")).alias("minus"), "s", "km")).alias("m"))
    return {r["id"]: (r["centre"], r["s"], r["score"]) for r in best.selectExpr("id", "-m.minus AS centre", "m.s AS s", "m.score AS score").collect()}


@pytest.mark.parametrize("size", [5, 4096])
def test_name_match_equals_that_of_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(matching, "PLACES", size)
    monkeypatch.setattr(matching, "CENTRES", size)
    a, b = places_and_centres()
    p, c = (spark.createDataFrame(rows, f"{k} long, block string, name string, lon double, lat double") for rows, k in ((a, "id"), (b, "centre")))
    got = {r["id"]: (r["centre"], r["similarity"], r["score"]) for r in matching.blocked_name_match(p, c).collect()}
    want = every_pair(p, c)
    assert {k: v for k, v in got.items() if k in want} == want and all(v == (None, None, None) for k, v in got.items() if k not in want)


def test_few_names_are_compared(monkeypatch):
    rng = random.Random(8)
    names = [f"supplier#{rng.randrange(10**9):09d}" for _ in range(800)]
    own = matching.Centres(names, np.zeros(800), np.linspace(0, 70, 800), list(range(800)))
    calls, real = [0], SequenceMatcher.ratio

    def counted(self):
        calls[0] += 1
        return real(self)

    monkeypatch.setattr(SequenceMatcher, "ratio", counted)
    for k in range(20):
        own.best(f"customer#{rng.randrange(10**9):09d}", 0.0, 3.5 * k)
    assert calls[0] < 20 * 800 / 4
