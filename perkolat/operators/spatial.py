"""Spatial operators over chords(graph_id, a, b, ax, ay, bx, by) and points(graph_id, node, x, y)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perkolat.functions.columns import proper_cross
from perkolat.lineage import small, written

from .graph import lcc_nodes

#: Metres of a degree of latitude, and of one of longitude at the equator, by which a disc is cut: fixed values.
M_PER_LAT, M_PER_LON = 111_132.0, 111_320.0
#: Most graphs whose rows are broadcast.
GRAPHS = 200_000


def chords(edges: DataFrame, points: DataFrame) -> DataFrame:
    a, b = (points.select("graph_id", F.col("node").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y")) for c in "ab")
    return edges.join(a, ["graph_id", "a"]).join(b, ["graph_id", "b"]).select("graph_id", "a", "b", "ax", "ay", "bx", "by")


def length(x: str = "") -> Column:
    return F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2))


def cells_of(ch: DataFrame, extent: Column, factor: float) -> DataFrame:
    """(graph_id, cell): factor times the median extent of a graph's chords; where that is 0 their largest, where that is 0 one."""
    median, most = F.percentile(extent, F.lit(0.5)) * factor, F.max(extent)
    cell = F.when(median > 0, median).when(most > 0, most).otherwise(1.0)
    return ch.groupBy("graph_id").agg(cell.alias("cell"))


def per_graph(df: DataFrame) -> DataFrame:
    """A table of a row for each graph, written, and broadcast if there are few."""
    return small(written(df, "per-graph"), GRAPHS)


def levels_of(own: DataFrame) -> DataFrame:
    """(graph_id, levels): few for each graph, logarithms of a ratio of lengths."""
    return per_graph(own.groupBy("graph_id").agg(F.sort_array(F.collect_set("level")).alias("levels")))


def crossings(ch: DataFrame, per_cell: float = 2.0) -> DataFrame:
    """(graph_id, e, f): pairs of chords without a common end that cross in an inner point, e < f.

    Chords meet in the cells of a grid that their boxes cover. Each chord has its own grid level, the smallest power of two at
    least its box; a pair meets on the coarser of its two levels, so that a long chord covers few cells, not many small ones."""
    box = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))
    level = F.when(box > F.col("cell"), F.ceil(F.log2(box / F.col("cell"))).cast("int")).otherwise(0)
    own = ch.join(per_graph(cells_of(ch, box, per_cell)), "graph_id").withColumn("level", level)
    own = own.join(levels_of(own), "graph_id").withColumn("at", F.explode(F.filter("levels", lambda v: v >= F.col("level"))))
    size = F.col("cell") * F.pow(F.lit(2.0), F.col("at"))
    span = lambda p, q: F.sequence(F.floor(F.least(p, q) / size), F.floor(F.greatest(p, q) / size))
    cells = own.withColumn("cx", F.explode(span("ax", "bx"))).withColumn("cy", F.explode(span("ay", "by")))
    key = ["graph_id", "at", "cx", "cy"]
    x, y = cells.alias("x"), cells.alias("y")
    on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in key]
    e, f = F.struct("x.a", "x.b"), F.struct("y.a", "y.b")
    apart = (F.col("x.a") != F.col("y.a")) & (F.col("x.a") != F.col("y.b")) & (F.col("x.b") != F.col("y.a")) & (F.col("x.b") != F.col("y.b"))
    meet = (F.greatest("x.level", "y.level") == F.col("x.at")) & (e < f) & apart
    cross = proper_cross(*[F.col(f"{s}.{c}") for s in "xy" for c in ("ax", "ay", "bx", "by")])
    joined = x.join(y, [*on, meet, cross])
    return joined.select(F.col("x.graph_id").alias("graph_id"), e.alias("e"), f.alias("f")).distinct()


def crossing_density(ch: DataFrame) -> DataFrame:
    """Per graph: m, crossings, chi = crossings / m."""
    m = ch.groupBy("graph_id").agg(F.count("*").alias("m"))
    c = crossings(ch).groupBy("graph_id").agg(F.count("*").alias("crossings"))
    return m.join(c, "graph_id", "left").na.fill(0, ["crossings"]).withColumn("chi", F.col("crossings") / F.col("m"))


def crossing_by_length(ch: DataFrame, q: float = 0.9) -> DataFrame:
    """Per graph crossings of two long, of a long and a short, and of two short chords; long: at least the q quantile of length."""
    cut = ch.groupBy("graph_id").agg(F.percentile(length(), F.lit(q)).alias("cut"))
    own = ch.join(per_graph(cut), "graph_id").select("graph_id", F.struct("a", "b").alias("e"), (length() >= F.col("cut")).cast("int").alias("long"))
    x = crossings(ch).join(own.withColumnRenamed("long", "l1"), ["graph_id", "e"]).join(own.withColumnsRenamed({"e": "f", "long": "l2"}), ["graph_id", "f"])
    n = F.col("l1") + F.col("l2")
    return x.groupBy("graph_id").agg(F.count_if(n == 2).alias("long_long"), F.count_if(n == 1).alias("long_short"), F.count_if(n == 0).alias("short_short"))


def crossing_angles(ch: DataFrame, least: float = 15.0) -> DataFrame:
    """Per graph crossings, those at an angle of at least `least` degrees, and the quartiles of the angle."""
    bearing = F.degrees(F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")))
    own = ch.select("graph_id", F.struct("a", "b").alias("e"), bearing.alias("t"))
    x = crossings(ch).join(own.withColumnRenamed("t", "t1"), ["graph_id", "e"]).join(own.withColumnsRenamed({"e": "f", "t": "t2"}), ["graph_id", "f"])
    d = F.pmod(F.abs(F.col("t1") - F.col("t2")), F.lit(180.0))
    x = x.withColumn("angle", F.least(d, 180 - d))
    return x.groupBy("graph_id").agg(F.count("*").alias("crossings"), F.count_if(F.col("angle") >= least).alias("wide"), *[F.percentile("angle", F.lit(p)).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])


def orientation(ch: DataFrame, bins: int = 18) -> DataFrame:
    """Per graph of bearings modulo 180 degrees: entropy of the bins over its maximum, share of the fullest, four-fold order."""
    t = F.pmod(F.degrees(F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax"))), F.lit(180.0))
    own = ch.select("graph_id", t.alias("t"), F.least(F.floor(t / (180.0 / bins)), F.lit(bins - 1)).alias("bin"))
    h = own.groupBy("graph_id", "bin").agg(F.count("*").alias("c"), F.sum(F.cos(F.radians(4 * F.col("t")))).alias("cs"), F.sum(F.sin(F.radians(4 * F.col("t")))).alias("sn"))
    total = F.sum("c").over(Window.partitionBy("graph_id"))
    h = h.withColumn("total", total).withColumn("p", F.col("c") / F.col("total"))
    fold = F.sqrt(F.pow(F.sum("cs"), 2) + F.pow(F.sum("sn"), 2)) / F.max("total")
    return h.groupBy("graph_id").agg((F.sum(-F.col("p") * F.log("p")) / math.log(bins)).alias("entropy"), F.max("p").alias("dominance"), fold.alias("four_fold"))


def junction_angles(ch: DataFrame, near: float = 10.0) -> DataFrame:
    """Per graph over all pairs of edges at a node: pairs, and shares within `near` degrees of straight and of right angles."""
    half = ch.select("graph_id", F.inline(F.array(
        F.struct(F.col("a").alias("node"), F.col("b").alias("other"), F.degrees(F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax"))).alias("t")),
        F.struct(F.col("b").alias("node"), F.col("a").alias("other"), F.degrees(F.atan2(F.col("ay") - F.col("by"), F.col("ax") - F.col("bx"))).alias("t")),
    )))
    x, y = half.alias("x"), half.alias("y")
    j = x.join(y, (F.col("x.graph_id") == F.col("y.graph_id")) & (F.col("x.node") == F.col("y.node")) & (F.col("x.other") < F.col("y.other")))
    d = F.pmod(F.abs(F.col("x.t") - F.col("y.t")), F.lit(360.0))
    j = j.select(F.col("x.graph_id").alias("graph_id"), F.least(d, 360 - d).alias("angle"))
    return j.groupBy("graph_id").agg(F.count("*").alias("pairs"), F.avg((F.col("angle") >= 180 - near).cast("double")).alias("straight"), F.avg((F.abs(F.col("angle") - 90) <= near).cast("double")).alias("right_angle"))


def knn(points: DataFrame, k: int, per_cell: float = 4.0) -> DataFrame:
    """(graph_id, node, other, rank): each point's k nearest others by distance, then id. Exact: rings of grid cells are searched
    outward; a point is done once its k-th neighbour is nearer than the ring's edge."""
    points = points.where("x is not null and y is not null")  # no others take part, or count
    g = points.groupBy("graph_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9)).alias("span"), F.count("*").alias("n"))
    g = g.withColumn("cell", F.col("span") / F.greatest(F.lit(1.0), F.sqrt(F.col("n") / per_cell)))
    own = points.join(per_graph(g), "graph_id")
    own = own.withColumn("cx", F.floor((F.col("x") - F.col("x0")) / F.col("cell"))).withColumn("cy", F.floor((F.col("y") - F.col("y0")) / F.col("cell")))
    target = own.select("graph_id", F.col("node").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), "cx", "cy")
    todo, done, ring = own, None, 1
    while True:
        r = F.sequence(F.lit(-ring), F.lit(ring))
        probe = todo.withColumn("dx", F.explode(r)).withColumn("dy", F.explode(r)).select("graph_id", "node", "x", "y", "cell", "n", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
        d = F.sqrt(F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2))
        near = probe.join(target, ["graph_id", "cx", "cy"]).where("node <> other").withColumn("d", d)
        near = written(near.withColumn("rank", F.row_number().over(Window.partitionBy("graph_id", "node").orderBy("d", "other"))).where(F.col("rank") <= k), "knn")
        full = near.groupBy("graph_id", "node").agg(F.count("*").alias("got"), F.max("d").alias("far"), F.max("cell").alias("cell"), F.max("n").alias("n"))
        full = full.where((F.col("got") >= F.least(F.lit(k), F.col("n") - 1)) & ((F.col("far") < ring * F.col("cell")) | (F.lit(ring) >= F.sqrt(F.col("n") / per_cell) + 1)))
        got = near.join(full.select("graph_id", "node"), ["graph_id", "node"], "left_semi").select("graph_id", "node", "other", "rank", "d")
        done = got if done is None else done.unionByName(got)
        todo = written(todo.join(full.select("graph_id", "node"), ["graph_id", "node"], "left_anti"), "knn-todo")
        if todo.where("n > 1").limit(1).count() == 0:
            return written(done, "knn-done")
        ring *= 2


def pruned(ch: DataFrame, points: DataFrame, rule: str) -> DataFrame:
    """Edges that no third point of the graph blocks: 'gabriel', none inside the circle on the edge; 'rng', none nearer to both ends
    than these are to each other. Points are looked for in the grid cells of the edge's neighbourhood alone."""
    if rule == "gabriel":
        mx, my, rad = (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2, length() / 2
    else:
        mx, my, rad = (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2, length()
    own = ch.withColumn("mx", mx).withColumn("my", my).withColumn("rad", rad)
    cell = per_graph(cells_of(own, F.col("rad"), 2.0))
    # An edge is looked up on the grid of its own level, the smallest power of two at least its radius: it covers few cells however long.
    level = F.when(F.col("rad") > F.col("cell"), F.ceil(F.log2(F.col("rad") / F.col("cell"))).cast("int")).otherwise(0)
    own = own.join(cell, "graph_id").withColumn("level", level)
    size = F.col("cell") * F.pow(F.lit(2.0), F.col("level"))
    span = lambda m: F.sequence(F.floor((F.col(m) - F.col("rad")) / size), F.floor((F.col(m) + F.col("rad")) / size))
    probe = own.withColumn("cx", F.explode(span("mx"))).withColumn("cy", F.explode(span("my")))
    at = points.join(cell, "graph_id").join(levels_of(own), "graph_id").withColumn("level", F.explode("levels"))
    at = at.select("graph_id", "level", F.col("node").alias("p"), F.col("x").alias("px"), F.col("y").alias("py"), F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    sq = lambda x, y: F.pow(F.col("px") - F.col(x), 2) + F.pow(F.col("py") - F.col(y), 2)
    d2 = F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2)
    third = (F.col("p") != F.col("a")) & (F.col("p") != F.col("b"))
    inside = (sq("ax", "ay") + sq("bx", "by") < d2) if rule == "gabriel" else (sq("ax", "ay") < d2) & (sq("bx", "by") < d2)
    blocked = probe.join(at, ["graph_id", "level", "cx", "cy"]).where(third & inside).select("graph_id", "a", "b").distinct()
    return ch.join(blocked, ["graph_id", "a", "b"], "left_anti").select("graph_id", "a", "b")


def disc(edges: DataFrame, points: DataFrame, centres: DataFrame, radius_m: float) -> DataFrame:
    """edges(graph_id, a, b) between points within a radius of their graph's centre(graph_id, lon, lat), cut down to the largest component
    of what is left; x is the longitude, y the latitude. A graph without an edge in its disc has no row."""
    near = F.pow((F.col("x") - F.col("lon")) * M_PER_LON * F.cos(F.radians("lat")), 2) + F.pow((F.col("y") - F.col("lat")) * M_PER_LAT, 2)
    inside = points.join(small(centres, GRAPHS), "graph_id").where(near <= radius_m * radius_m).select("graph_id", "node")
    own = edges.select("graph_id", "a", "b")
    for end in "ab":
        own = own.join(inside.withColumnRenamed("node", end), ["graph_id", end], "left_semi")
    own = written(own.select("graph_id", "a", "b"), "disc")
    return own.join(lcc_nodes(own).withColumnRenamed("node", "a"), ["graph_id", "a"], "left_semi").select("graph_id", "a", "b")
