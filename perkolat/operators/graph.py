"""Graph operators over edges(graph_id, src, dst) and nodes(graph_id, node). Degrees, moments, line graphs, walks, generators."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perkolat.functions.columns import cebh, junction_anchor
from perkolat.lineage import written

from .components import components


def simple(edges: DataFrame, multi: bool = False) -> DataFrame:
    """Undirected edges a < b without loops; parallel ones once unless multi."""
    out = edges.where("src <> dst").select("graph_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return out if multi else out.distinct()


def first_wins(edges: DataFrame, order: str) -> DataFrame:
    """The first edge, by `order`, of each unordered pair, with all its columns."""
    key = [F.col("graph_id"), F.least("src", "dst"), F.greatest("src", "dst")]
    return edges.where("src <> dst").withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_r = 1").drop("_r")


def ends(edges: DataFrame) -> DataFrame:
    """(graph_id, node, other): both ends of each edge(a, b)."""
    return edges.select("graph_id", F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))))


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    out = ends(edges).groupBy("graph_id", "node").agg(F.count("*").alias("degree"))
    return out if nodes is None else nodes.join(out, ["graph_id", "node"], "left").na.fill(0, ["degree"])


def moments(deg: DataFrame) -> DataFrame:
    """Per graph: n, m, k1, k2, kappa, cebh, two_over_k, shares of degrees 1, 2, 3 and 4 or more, the junction anchor.

    One pass over a histogram of degrees, so that a graph of any size shuffles only its distinct degrees."""
    h = deg.groupBy("graph_id", "degree").agg(F.count("*").alias("c"))
    of = lambda cond: F.sum(F.when(cond, F.col("c")).otherwise(0))
    d = F.col("degree")
    g = h.groupBy("graph_id").agg(F.sum("c").alias("n"), F.sum(d * F.col("c")).alias("s1"), F.sum(d * d * F.col("c")).alias("s2"), of(d == 1).alias("n1"), of(d == 2).alias("n2"), of(d == 3).alias("n3"), of(d >= 4).alias("n4"))
    k1, k2, n = F.col("s1") / F.col("n"), F.col("s2") / F.col("n"), F.col("n")
    return g.select(
        "graph_id", "n", (F.col("s1") / 2).cast("long").alias("m"), k1.alias("k1"), k2.alias("k2"), F.try_divide(k2, k1).alias("kappa"), cebh(k1, k2).alias("cebh"), F.try_divide(F.lit(2.0), k1).alias("two_over_k"),
        *[(F.col(f"n{i}") / n).alias(f"share{i}") for i in (1, 2, 3, 4)], junction_anchor(F.col("n3"), F.col("n4")).alias("anchor"),
    )


def gini(deg: DataFrame, value: str = "degree") -> DataFrame:
    """Per graph the Gini coefficient of a value, from its histogram: the window holds distinct values, not nodes."""
    h = deg.groupBy("graph_id", F.col(value).alias("v")).agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("graph_id").orderBy("v")) - F.col("c")
    h = h.withColumn("ranks", F.col("c") * before + F.col("c") * (F.col("c") + 1) / 2)
    n, s = F.sum("c"), F.sum(F.col("c") * F.col("v"))
    return h.groupBy("graph_id").agg(F.when(s > 0, (2 * F.sum(F.col("ranks") * F.col("v")) - (n + 1) * s) / (n * s)).otherwise(0.0).alias("gini"))


def dual_degree(edges: DataFrame) -> DataFrame:
    """Per graph mean and coefficient of variation of the edges' degree in the line graph, k_a + k_b - 2."""
    deg = degrees(edges)
    a, b = (deg.select("graph_id", F.col("node").alias(c), F.col("degree").alias(f"d{c}")) for c in "ab")
    k = F.col("da") + F.col("db") - 2
    return edges.join(a, ["graph_id", "a"]).join(b, ["graph_id", "b"]).groupBy("graph_id").agg(F.avg(k).alias("mean"), F.try_divide(F.stddev_pop(k), F.avg(k)).alias("cv"))


def labelled(edges: DataFrame) -> DataFrame:
    """(graph_id, node, component): the smallest node reachable. Graphs are labelled together."""
    node = lambda c: F.struct("graph_id", F.col(c).alias("node"))
    cc = components(edges.select(node("a").alias("a"), node("b").alias("b")))
    return cc.select("node.graph_id", "node.node", F.col("component.node").alias("component"))


def component_summary(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Per graph: nodes, components, the largest one's share, cyclomatic number and density. Isolated nodes are components of their own."""
    own = labelled(edges)
    if nodes is not None:
        own = nodes.join(own, ["graph_id", "node"], "left").withColumn("component", F.coalesce("component", "node"))
    sizes = own.groupBy("graph_id", "component").agg(F.count("*").alias("size"))
    g = sizes.groupBy("graph_id").agg(F.sum("size").alias("n"), F.count("*").alias("components"), (F.max("size") / F.sum("size")).alias("lcc"))
    m = edges.groupBy("graph_id").agg(F.count("*").alias("m"))
    cyc = F.greatest(F.lit(0), F.col("m") - F.col("n") + F.col("components"))
    return g.join(m, "graph_id", "left").na.fill(0, ["m"]).select("graph_id", "n", "m", "components", "lcc", cyc.alias("cyclomatic"), (cyc / F.col("n")).alias("cyclomatic_density"))


def hops(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(graph_id, source, node, hops) from each source(graph_id, source): breadth first by joins until no new node is met, each level
    written. With `most`, only nodes within that many hops are wanted, and no level beyond it is looked for."""
    both = written(ends(edges), "hops-ends")
    key = ["graph_id", "source", "node"]
    front = written(sources.select("graph_id", "source", F.col("source").alias("node"), F.lit(0).alias("hops")), "hops")
    before, levels = None, [front]
    for level in itertools.count(1) if most is None else range(1, most + 1):
        step = front.select(*key).join(both, ["graph_id", "node"]).select("graph_id", "source", F.col("other").alias("node")).distinct()
        new = step.join(front, key, "left_anti")  # a neighbour of this level is in it, in the one before or new
        new = new if before is None else new.join(before, key, "left_anti")
        before, front = front, written(new.withColumn("hops", F.lit(level)), "hops")
        if front.limit(1).count() == 0:
            break
        levels.append(front)
    out = levels[0]
    for df in levels[1:]:
        out = out.unionByName(df)
    return out


def edge_jaccard(x: DataFrame, y: DataFrame) -> DataFrame:
    """Per graph |x and y| / |x or y| of edge sets (a, b); an empty union gives null."""
    flags = x.select("graph_id", "a", "b", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(y.select("graph_id", "a", "b", F.lit(0).alias("x"), F.lit(1).alias("y")))
    e = flags.groupBy("graph_id", "a", "b").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    return e.groupBy("graph_id").agg((F.sum(F.col("x") * F.col("y")) / F.count("*")).alias("jaccard"))


def line_graph(edges: DataFrame) -> DataFrame:
    """(graph_id, e, f): pairs of edges that share a node, e < f as structs of their ends. Grows with the squares of degrees."""
    inc = ends(edges).select("graph_id", "node", F.struct(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).alias("e"))
    x, y = inc.alias("x"), inc.alias("y")
    on = (F.col("x.graph_id") == F.col("y.graph_id")) & (F.col("x.node") == F.col("y.node")) & (F.col("x.e") < F.col("y.e"))
    return x.join(y, on).select("x.graph_id", F.col("x.e").alias("e"), F.col("y.e").alias("f")).distinct()


def line_graph_jaccard(x: DataFrame, y: DataFrame) -> DataFrame:
    return edge_jaccard(line_graph(x).withColumnsRenamed({"e": "a", "f": "b"}), line_graph(y).withColumnsRenamed({"e": "a", "f": "b"}))


def lattice(spark: SparkSession, kind: str, side: int) -> DataFrame:
    """A periodic lattice of side x side cells: square, triangular, or honeycomb as bricks (an even side)."""
    cells = spark.range(side * side).select((F.col("id") % side).alias("i"), F.floor(F.col("id") / side).alias("j"))
    at = lambda i, j: F.pmod(j, F.lit(side)) * side + F.pmod(i, F.lit(side))
    step = lambda di, dj: F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj"))
    i, j = F.col("i"), F.col("j")
    to = {
        "square": [step(1, 0), step(0, 1)],
        "triangular": [step(1, 0), step(0, 1), step(1, 1)],
        "honeycomb": [step(1, 0), F.when((i + j) % 2 == 0, step(0, 1))],
    }[kind]
    steps = F.filter(F.array(*to), lambda x: x.isNotNull())
    e = cells.select("i", "j", F.explode(steps).alias("s"))
    return simple(e.select(F.lit(kind).alias("graph_id"), at(i, j).alias("src"), at(i + F.col("s.di"), j + F.col("s.dj")).alias("dst")))


def hashed(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def numbered(df: DataFrame, group: list[str], h: str, order: list[str]) -> DataFrame:
    """df with `r`, from 0 within each group in the order of a hexadecimal hash and then `order`: rows are numbered within buckets of the
    hash, whose counts give the offsets, so that no task sorts a whole group. df is read twice; it should be cheap or written."""
    own = df.withColumn("_b", F.substring(h, 1, 3))
    counts = own.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    first = counts.withColumn("_first", F.sum("_n").over(Window.partitionBy(*group).orderBy("_b")) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy(*group, "_b").orderBy(h, *order)) - 1
    return own.withColumn("_k", place).join(first, [*group, "_b"]).withColumn("r", F.col("_first") + F.col("_k")).drop("_b", "_k", "_first")


def configuration_projection(edges: DataFrame, seed: int) -> DataFrame:
    """Stubs in the order of a seeded hash, paired two by two within a graph, loops dropped and parallel edges collapsed: degrees are kept nearly."""
    stubs = ends(edges).select("graph_id", "node", hashed(F.lit(seed), F.col("node"), F.col("other")).alias("h"))
    pairs = numbered(stubs, ["graph_id"], "h", ["node"]).groupBy("graph_id", F.floor(F.col("r") / 2).alias("k")).agg(F.min("node").alias("src"), F.max("node").alias("dst"), F.count("*").alias("c")).where("c = 2")
    return simple(pairs.select("graph_id", "src", "dst"))


def shortcuts(edges: DataFrame, fraction: float, seed: int) -> DataFrame:
    """edges and floor(fraction * m) random pairs of nodes, numbered in the order of their hash, per graph; loops are dropped, duplicates stay."""
    nodes = ends(edges).select("graph_id", "node").distinct().withColumn("h", hashed(F.col("node")))
    nodes = numbered(nodes, ["graph_id"], "h", ["node"]).drop("h")
    size = nodes.groupBy("graph_id").agg(F.count("*").alias("n")).join(edges.groupBy("graph_id").agg(F.count("*").alias("m")), "graph_id")
    draw = size.where(F.floor(F.lit(fraction) * F.col("m")) > 0).select("graph_id", "n", F.explode(F.sequence(F.lit(1), F.floor(F.lit(fraction) * F.col("m")))).alias("k"))
    pick = lambda side: F.conv(F.substring(hashed(F.lit(seed), F.lit(side), F.col("graph_id"), F.col("k")), 1, 12), 16, 10).cast("long") % F.col("n")
    drawn = draw.select("graph_id", pick("a").alias("ra"), pick("b").alias("rb")).where("ra <> rb")
    a, b = (nodes.select("graph_id", F.col("node").alias(c), F.col("r").alias(f"r{c}")) for c in "ab")
    new = drawn.join(a, ["graph_id", "ra"]).join(b, ["graph_id", "rb"]).select("graph_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return edges.select("graph_id", "a", "b").unionByName(new)


def lcc_nodes(edges: DataFrame) -> DataFrame:
    """(graph_id, node): the nodes of each graph's largest component; of equal ones that with the least node."""
    own = labelled(edges)
    size = own.groupBy("graph_id", "component").agg(F.count("*").alias("size"))
    best = size.groupBy("graph_id").agg(F.min(F.struct((-F.col("size")).alias("s"), "component")).alias("m")).select("graph_id", F.col("m.component").alias("component"))
    return own.join(best, ["graph_id", "component"], "left_semi").select("graph_id", "node")


def sampled_pairs(nodes: DataFrame, pairs: int, seed: int) -> DataFrame:
    """(graph_id, source, target): `pairs` pairs of different nodes of each graph by hash; fewer where a pair is drawn twice."""
    own = numbered(nodes.withColumn("h", hashed(F.col("node"))), ["graph_id"], "h", ["node"]).drop("h")
    n = own.groupBy("graph_id").agg(F.count("*").alias("n")).where("n > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(pairs))))
    pick = lambda side: F.conv(F.substring(hashed(F.lit(seed), F.lit(side), F.col("k")), 1, 12), 16, 10).cast("long") % F.col("n")
    drawn = n.select("graph_id", pick("a").alias("ra"), pick("b").alias("rb")).where("ra <> rb")
    a, b = (own.select("graph_id", F.col("node").alias(c), F.col("r").alias(f"r{i}")) for c, i in (("source", "a"), ("target", "b")))
    return drawn.join(a, ["graph_id", "ra"]).join(b, ["graph_id", "rb"]).select("graph_id", "source", "target").distinct()


def diluted_square(spark: SparkSession, side: int, percent: int, seed: int) -> DataFrame:
    """Edges of an open square lattice that a hash keeps, percent of them in the mean."""
    cells = spark.range(side * side).select(F.floor(F.col("id") / side).alias("x"), (F.col("id") % side).alias("y"))
    step = F.explode(F.array(F.struct(F.lit(1).alias("dx"), F.lit(0).alias("dy")), F.struct(F.lit(0).alias("dx"), F.lit(1).alias("dy"))))
    e = cells.select("x", "y", step.alias("s")).where((F.col("x") + F.col("s.dx") < side) & (F.col("y") + F.col("s.dy") < side))
    e = e.select(F.lit("diluted").alias("graph_id"), (F.col("x") * side + F.col("y")).alias("a"), ((F.col("x") + F.col("s.dx")) * side + F.col("y") + F.col("s.dy")).alias("b"))
    return e.where(F.conv(F.substring(hashed(F.lit(seed), F.col("a"), F.col("b")), 1, 8), 16, 10).cast("long") % 100 < percent)


def vertex_split(edges: DataFrame, percent: int, seed: int) -> DataFrame:
    """(graph_id, a, b): nodes of degree 4 that a hash chooses, percent of them in the mean, become two of degree 3 joined by an edge; the
    two first of their neighbours, by number, stay, the others go to the new node, which has the number -1 - node (nodes are not negative)."""
    deg = degrees(edges).where("degree = 4")
    chosen = deg.where(F.conv(F.substring(hashed(F.lit(seed), F.col("node")), 1, 8), 16, 10).cast("long") % 100 < percent).select("graph_id", "node")
    half = ends(edges).join(chosen, ["graph_id", "node"])
    moved = half.withColumn("k", F.row_number().over(Window.partitionBy("graph_id", "node").orderBy("other"))).where("k > 2").select("graph_id", "node", "other")
    m1 = moved.select("graph_id", F.col("node").alias("a"), F.col("other").alias("b"), F.lit(True).alias("ma"))
    m2 = moved.select("graph_id", F.col("other").alias("a"), F.col("node").alias("b"), F.lit(True).alias("mb"))
    e = edges.select("graph_id", "a", "b").join(m1, ["graph_id", "a", "b"], "left").join(m2, ["graph_id", "a", "b"], "left")
    src, dst = F.when(F.col("ma"), -1 - F.col("a")).otherwise(F.col("a")), F.when(F.col("mb"), -1 - F.col("b")).otherwise(F.col("b"))
    new = chosen.select("graph_id", (-1 - F.col("node")).alias("src"), F.col("node").alias("dst"))
    return simple(e.select("graph_id", src.alias("src"), dst.alias("dst")).unionByName(new))
