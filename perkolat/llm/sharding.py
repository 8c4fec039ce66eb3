"""Sharding by a k-d tree over metadata. Native.

Every node is split at the distributed weighted median of its widest dimension, until leaves reach the target bytes. The
median is found by histograms: each round counts bytes by bin within every open node's bracket and narrows the bracket to
the bin that holds the median, for all nodes at once. Only brackets, one row for each node, reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, small, table, text_of, written

SHARDS, BINS, ROUNDS, SLOT_BUCKETS = 16, 4096, 4, 256
#: Most values of a dimension whose weights are broadcast; more are shuffled.
MAX_BROADCAST = 100_000
#: A dimension's coordinate: its value in the high bits, a hash of the row in the low ones, so that ties can be split.
LOW = 2**20


def coordinate(value: Column, row_hash: Column) -> Column:
    """value: 0 to 2^31 - 1."""
    return value.cast("long") * F.lit(LOW) + F.pmod(row_hash, F.lit(LOW))


def by_weight(base: DataFrame, col: str) -> DataFrame:
    """base with `col` as 31 bits: the logarithm of the bytes that share its value, then a hash of the value, so that the rows of a value
    lie together and values of like weight are neighbours."""
    weight = F.least(F.log2(F.sum("size").cast("double")) * 2.0**14, F.lit(2.0**20 - 1)).cast("long")
    own = base.groupBy(F.col(col).alias("_v")).agg((weight * 2048 + F.pmod(F.crc32("_v"), F.lit(2048))).alias("_w"))
    own = small(written(own, "shard-weights"), MAX_BROADCAST)
    return base.join(own, F.col(col) == F.col("_v")).withColumn(col, F.col("_w")).drop("_v", "_w")


def points(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, doc_id, size, text_crc32 and the coordinates x0 (length), x1 (source) and x2 (language), both by weight, and x3 (the id by value
    between the least and the greatest; 0 if it is no number). Written."""
    text = text_of(text_col)
    size = F.octet_length(text).cast("long") + 1
    names = {c.lower() for c in docs.columns}
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in names else F.lit("")
    number = F.col(id_col).try_cast("double")
    lo, hi = docs.agg(F.min(number), F.max(number)).first()
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"), of("source").alias("v1"), of("lang").alias("v2"))
    base = written(base, "shard-base")
    length = F.least(F.log2(F.col("size").cast("double")) * F.lit(2.0**25), F.lit(2.0**31 - 1))
    place = (F.col("doc_id").try_cast("double") - F.lit(lo)) / F.lit(max((hi or 0.0) - (lo or 0.0), 1.0)) * F.lit(2.0**31 - 1)
    h = F.xxhash64(F.col("doc_id").cast("string"), "text_crc32", "rid")
    dims = (length, F.col("v1"), F.col("v2"), F.coalesce(place, F.lit(0.0)))
    own = by_weight(by_weight(base, "v1"), "v2")
    return written(own.select("rid", "doc_id", "size", "text_crc32", *[coordinate(v, h).alias(f"x{i}") for i, v in enumerate(dims)]), "shard-points")


def of_node(values: dict[int, int | float], leaves: int, kind: str) -> Column:
    """The value of a row's `node`, -1 for nodes without one. The values are one constant of the plan and not part of its code, so that the
    rounds of a tree are compiled once, and no join is needed."""
    return F.split(F.lit(",".join(str(values.get(n, -1)) for n in range(leaves))), ",").cast(f"array<{kind}>")[F.col("node").cast("int")]


def along(dims: range | list[int]) -> Column:
    """The coordinate in dimension `d`."""
    return F.coalesce(*[F.when(F.col("d") == i, F.col(f"x{i}")) for i in dims])


def split_once(pts: DataFrame, open_nodes: list[int], spread: list[float], left_share: dict[int, float], leaves: int) -> list[tuple[int, int, int]]:
    """(node, dimension, bound) for each open node: rows with a coordinate of at most bound go left, about left_share of its bytes.

    pts has `node`, under `leaves`, and the coordinates. The widest dimension is the one whose range is largest against its range over all
    rows."""
    dims = range(len(spread))
    ranges = pts.where(of_node(dict.fromkeys(open_nodes, 1), leaves, "int") == 1).groupBy("node").agg(F.sum("size").alias("size"), *[f(F.col(f"x{i}")).alias(f"{n}{i}") for i in dims for n, f in (("lo", F.min), ("hi", F.max))]).collect()
    at: dict[int, list] = {}  # node: dimension, lo, hi, bytes wanted at or below the bound, bytes below lo, bytes up to hi
    for r in ranges:
        d = max(dims, key=lambda i: ((r[f"hi{i}"] - r[f"lo{i}"]) / max(spread[i], 1.0), -i))
        at[r["node"]] = [d, r[f"lo{d}"], r[f"hi{d}"], r["size"] * left_share[r["node"]], 0.0, float(r["size"])]
    for _ in range(ROUNDS):
        live = {n: (*v[:5], max(1, -(-(v[2] - v[1] + 1) // BINS))) for n, v in at.items() if v[1] < v[2]}
        if not live:
            break
        col = lambda i, kind="long": of_node({n: v[i] for n, v in live.items()}, leaves, kind)  # noqa: E731, B023
        here = pts.select("node", "size", *[f"x{i}" for i in dims], col(0, "int").alias("d")).where("d >= 0")
        inside = here.select("node", "size", along(dims).alias("x"), col(1).alias("lo"), col(2).alias("hi"), col(5).alias("step")).where("x between lo and hi")
        bins = inside.groupBy("node", F.floor((F.col("x") - F.col("lo")) / F.col("step")).alias("bin")).agg(F.sum("size").alias("s"))
        by = Window.partitionBy("node").orderBy("bin")
        upto = bins.select("node", "bin", "s", (col(4, "double") + F.sum("s").over(by)).alias("upto"), F.lead("bin").over(by).isNull().alias("last"), col(3, "double").alias("want"))
        for r in upto.where("(upto >= want and upto - s < want) or (last and upto < want)").select("node", "bin", "s", "upto").collect():
            v, step = at[r["node"]], live[r["node"]][5]
            lo = v[1] + int(r["bin"]) * step
            v[1], v[2], v[4], v[5] = lo, min(lo + step - 1, v[2]), r["upto"] - r["s"], r["upto"]
    return [(n, d, lo - 1 if 0 < below and want - below < upto - want else hi) for n, (d, lo, hi, want, below, upto) in at.items()]


def tree(pts: DataFrame, leaves: int) -> DataFrame:
    """pts, written, with `shard`, 0 to leaves - 1: the leaves of the tree, left to right. A node for k leaves gives k // 2 to its left. Each
    level is written, so that no plan holds those before it; the last is not."""
    dims = [c for c in pts.columns if c[0] == "x"]
    ends = pts.agg(*[f(c) for c in dims for f in (F.min, F.max)]).first()
    spread = [float((ends[2 * i + 1] or 0) - (ends[2 * i] or 0)) for i in range(len(dims))]
    own = pts.withColumn("node", F.lit(0).cast("long"))
    nodes = {0: leaves}  # first leaf: number of leaves
    before = None
    while any(k > 1 for k in nodes.values()):
        wide = {n: k for n, k in nodes.items() if k > 1}
        cuts = split_once(own, list(wide), spread, {n: (k // 2) / k for n, k in wide.items()}, leaves)
        if not cuts:
            break
        cut = own.withColumn("d", of_node({n: d for n, d, _ in cuts}, leaves, "int")).withColumn("x", along(range(len(dims))))
        right = F.col("x") > of_node({n: b for n, _, b in cuts}, leaves, "long")
        cut = cut.withColumn("node", F.when(right, F.col("node") + of_node({n: wide[n] // 2 for n, *_ in cuts}, leaves, "long")).otherwise(F.col("node"))).drop("d", "x")
        nodes = {m: k for n, k0 in nodes.items() for m, k in (((n, k0 // 2), (n + k0 // 2, k0 - k0 // 2)) if k0 > 1 else ((n, k0),))}
        if all(k == 1 for k in nodes.values()):
            own = cut
            break
        own = written(cut, "shard-level")
        if before is not None:
            dropped(before)
        before = own
    return own.withColumn("shard", F.col("node").cast("int")).drop("node", *dims)


def slots(sharded: DataFrame) -> DataFrame:
    """sharded with `slot`: 0, 1, 2 ... within each shard. Rows are numbered within hash buckets of a shard, whose counts give
    the offsets, so that no task sorts a whole shard."""
    rows = sharded.withColumn("b", F.pmod(F.xxhash64("rid"), F.lit(SLOT_BUCKETS)).cast("int"))
    n = rows.groupBy("shard", "b").agg(F.count("*").alias("n"))
    first = n.select("shard", "b", (F.sum("n").over(Window.partitionBy("shard").orderBy("b")) - F.col("n")).alias("first"))
    k = F.row_number().over(Window.partitionBy("shard", "b").orderBy("doc_id", "rid")) - 1
    return rows.withColumn("k", k).join(small(written(first, "shard-slots"), 1_000_000), ["shard", "b"]).withColumn("slot", F.col("first") + F.col("k")).drop("b", "k", "first")


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of docs. shards: how many; or target_bytes: as many as bring
    leaves to that size. A null text counts one byte; null ids, repeated rows and ties are told apart by their place in the
    input; a very long text is one point, which no cut divides; other columns than source and lang are not read; an empty table gives no
    rows."""
    pts = points(docs)
    if shards is None:
        total = pts.agg(F.sum("size")).first()[0] or 0
        shards = max(1, math.ceil(total / target_bytes))
    return slots(written(tree(pts, shards), "shard-leaves"))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", F.col("text_crc32").cast("long").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


SQL: dict[str, str] = {}
QUERIES = {"op10_kd_shards": op10_kd_shards}
