"""What queries share: tables, fixtures derived from them, rounding, registration."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perkolat.functions.columns import finite
from perkolat.operators import graph, spatial

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Suppliers' nodes come after all parts'.
OFFSET = 1_000_000_000_000


def query(sql: str | None = None):
    """Register a function under its name, with the SQL of the same rows."""

    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: rounded(fn(Tables(spark, sf_dir)))
        if sql:
            SQL[fn.__name__] = re.sub(r"\bby\b", "y2", sql)  # a column of chords that is a keyword there
        return fn

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to six places, no negative zero: sums of doubles depend on their order."""
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def R(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0)"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def brand_edges(self, multi: bool = False) -> DataFrame:
        """A graph for each brand: parts and the suppliers of their line items."""
        parts = self.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("graph_id"))
        e = self.lineitem.select("l_partkey", "l_suppkey").join(parts, "l_partkey")
        return graph.simple(e.select("graph_id", F.col("l_partkey").alias("src"), (F.col("l_suppkey") + OFFSET).alias("dst")), multi)

    def points(self) -> DataFrame:
        at = lambda i: finite(F.col("embedding")[i])
        return self.embeddings.select(F.lit("emb").alias("graph_id"), F.col("vec_id").alias("node"), at(0).alias("x"), at(1).alias("y"))

    def near_edges(self) -> DataFrame:
        """Each point joined to its two nearest."""
        return graph.simple(spatial.knn(self.points(), 2).select("graph_id", F.col("node").alias("src"), F.col("other").alias("dst")))

    def chords(self) -> DataFrame:
        return spatial.chords(self.near_edges(), self.points())

    def networks(self) -> DataFrame:
        """A row for each brand's graph: thresholds by degree moments, 2 / <k>, and one shifted by the mean discount as the observed."""
        m = graph.moments(graph.degrees(self.brand_edges()))
        parts = self.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("graph_id"))
        disc = self.lineitem.select("l_partkey", "l_discount").join(parts, "l_partkey").groupBy("graph_id").agg(F.avg("l_discount").alias("d"))
        j = m.join(disc, "graph_id")
        nine = lambda c: F.round(c, 9)
        return j.select(
            F.col("graph_id").alias("city"), F.substring("graph_id", 1, 7).alias("domain"), "n", "m", nine(F.col("k1")).alias("mean_degree"), nine(F.col("kappa")).alias("kappa"),
            nine(F.col("two_over_k") * (0.5 + 10 * F.col("d"))).alias("pc_obs"), nine(F.col("cebh")).alias("pc_cebh"), nine(F.col("two_over_k")).alias("pc_derived"),
        )


EDGES = f"""e AS (SELECT DISTINCT p_brand AS graph_id, l_partkey AS a, l_suppkey + {OFFSET} AS b FROM lineitem JOIN part ON l_partkey = p_partkey),
deg AS (SELECT graph_id, node, count(*) AS degree FROM (SELECT graph_id, a AS node FROM e UNION ALL SELECT graph_id, b FROM e) GROUP BY ALL)"""
MOMENTS = f"""{EDGES},
mo AS (SELECT graph_id, count(*) AS n, (sum(degree) / 2)::BIGINT AS m, avg(degree) AS k1, avg(degree * degree) AS k2,
  count(*) FILTER (degree = 3) AS n3, count(*) FILTER (degree >= 4) AS n4, avg((degree = 1)::INT) AS share1, avg((degree = 2)::INT) AS share2, avg((degree = 3)::INT) AS share3, avg((degree >= 4)::INT) AS share4 FROM deg GROUP BY graph_id)"""
NETWORKS = f"""{MOMENTS},
disc AS (SELECT p_brand AS graph_id, avg(l_discount) AS d FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand),
nets AS (SELECT graph_id AS city, substr(graph_id, 1, 7) AS domain, n, m, round(k1, 9) AS mean_degree, round(k2 / k1, 9) AS kappa, round(2 / k1 * (0.5 + 10 * d), 9) AS pc_obs,
  round(CASE WHEN k2 - k1 > 0 THEN k1 / (k2 - k1) END, 9) AS pc_cebh, round(2 / k1, 9) AS pc_derived FROM mo JOIN disc USING (graph_id)),
f AS (SELECT *, 1 - pc_obs AS fc_obs, 1 - pc_cebh AS fc_cebh, 1 - pc_derived AS fc_derived, pc_obs - pc_cebh AS overrating FROM nets)"""
NEAR = """p AS (SELECT 'emb' AS graph_id, vec_id AS node, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
nn AS (SELECT node, other, rank, d FROM (SELECT u.node, v.node AS other, sqrt(pow(u.x - v.x, 2) + pow(u.y - v.y, 2)) AS d,
  row_number() OVER (PARTITION BY u.node ORDER BY sqrt(pow(u.x - v.x, 2) + pow(u.y - v.y, 2)), v.node) AS rank FROM p u JOIN p v ON u.node <> v.node) WHERE rank <= 2),
e AS (SELECT DISTINCT 'emb' AS graph_id, least(node, other) AS a, greatest(node, other) AS b FROM nn),
ch AS (SELECT e.*, u.x AS ax, u.y AS ay, v.x AS bx, v.y AS by, sqrt(pow(v.x - u.x, 2) + pow(v.y - u.y, 2)) AS len FROM e JOIN p u ON u.node = a JOIN p v ON v.node = b),
sides AS (SELECT s.a, s.b, t.a AS c, t.b AS d, s.len AS len1, t.len AS len2,
  abs(degrees(atan2(s.by - s.ay, s.bx - s.ax)) - degrees(atan2(t.by - t.ay, t.bx - t.ax))) % 180 AS turn,
  sign((s.bx - s.ax) * (t.ay - s.ay) - (s.by - s.ay) * (t.ax - s.ax)) * sign((s.bx - s.ax) * (t.by - s.ay) - (s.by - s.ay) * (t.bx - s.ax)) AS s1,
  sign((t.bx - t.ax) * (s.ay - t.ay) - (t.by - t.ay) * (s.ax - t.ax)) * sign((t.bx - t.ax) * (s.by - t.ay) - (t.by - t.ay) * (s.bx - t.ax)) AS s2
  FROM ch s JOIN ch t ON (s.a < t.a OR (s.a = t.a AND s.b < t.b)) AND s.a <> t.a AND s.a <> t.b AND s.b <> t.a AND s.b <> t.b),
x AS (SELECT *, least(turn, 180 - turn) AS angle FROM sides WHERE s1 < 0 AND s2 < 0)"""
