"""Rank-order bond percolation. Edges enter in the order of a seeded hash; the largest cluster's share is read at k = rint(p m).

One task holds one permutation of one graph; permutations and graphs are dealt over the cluster. Thresholds and their bootstrap
intervals are windows and joins over the curves.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perkolat.lineage import written

from .graph import hashed


def grid(lo: float, hi: float, step: float) -> list[float]:
    """lo, lo + step ... up to hi, counted in steps so that nothing drifts."""
    return [round(lo + i * step, 10) for i in range(int(round((hi - lo) / step)) + 1)]


class Clusters:
    """Union by size with path halving."""

    def __init__(self, n: int):
        self.parent, self.size, self.largest = list(range(n)), [1] * n, min(n, 1)

    def find(self, a: int) -> int:
        p = self.parent
        while p[a] != a:
            p[a] = p[p[a]]
            a = p[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if self.size[a] < self.size[b]:
            a, b = b, a
        self.parent[b] = a
        self.size[a] += self.size[b]
        self.largest = max(self.largest, self.size[a])
        return True


def lcc_curve(a: np.ndarray, b: np.ndarray, ps: list[float]) -> np.ndarray:
    """Shares of the largest cluster after the first rint(p m) edges (a, b) in order, over the nodes that the edges name."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    m, n = len(a), len(nodes)
    ks = np.rint(np.array(ps) * m).astype(int)
    out, c, done = np.empty(len(ps)), Clusters(n), 0
    x, y = at[:m].tolist(), at[m:].tolist()
    for i in np.argsort(ks, kind="stable"):
        while done < ks[i]:
            c.join(x[done], y[done])
            done += 1
        out[i] = c.largest / n
    return out


def curves(edges: DataFrame, perms: int, ps: list[float], seed: int) -> DataFrame:
    """(graph_id, perm, p_idx, p, lcc) for edges(graph_id, a, b)."""
    return ordered_curves(edges, perms, seed, lambda pdf: ps)


def ordered_curves(edges: DataFrame, perms: int, seed: int, grid_of: Callable[[pd.DataFrame], list[float]]) -> DataFrame:
    """curves() on the grid that a graph's rows give."""
    own = edges.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(perms))))
    own = own.withColumn("h", hashed(F.lit(seed), F.col("perm"), F.col("a"), F.col("b")))

    def work(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, ps = pdf.sort_values(["h", "a", "b"]), grid_of(pdf)
        y = lcc_curve(pdf["a"].to_numpy(), pdf["b"].to_numpy(), ps)
        return pd.DataFrame({"graph_id": key[0], "perm": key[1], "p_idx": np.arange(len(ps), dtype=np.int32), "p": ps, "lcc": y})

    kind = dict(edges.dtypes)["graph_id"]
    return own.groupBy("graph_id", "perm").applyInPandas(work, f"graph_id {kind}, perm int, p_idx int, p double, lcc double")


def fine_grid(pc: float, width: float, step: float, lo: float = 0.03, hi: float = 0.97) -> list[float]:
    """Steps from pc - width to pc + width, within [lo, hi]."""
    first, last = max(lo, pc - width), min(hi, pc + width)
    return [round(first + i * step, 4) for i in range(int((last - first) / step + 1e-6) + 1)]


def fine_threshold(edges: DataFrame, seed: int, coarse: tuple[int, list[float]], perms: int = 24, reps: int = 200, width: float = 0.06, step: float = 0.005) -> DataFrame:
    """(graph_id, pc_coarse, pc, pc_mean, ci_low, ci_high, boundary_share): a threshold by coarse = (permutations, grid), then again, with
    other orders, on a fine grid about it, with a bootstrap over the permutations."""
    first = written(threshold(curves(edges, coarse[0], coarse[1], seed)).select("graph_id", F.col("pc").alias("pc_coarse")), "pc-coarse")
    about = edges.select("graph_id", "a", "b").join(first, "graph_id")
    cv = written(ordered_curves(about, perms, seed + 1, lambda pdf: fine_grid(float(pdf["pc_coarse"].iloc[0]), width, step)), "pc-fine")
    return first.join(threshold(cv).select("graph_id", "pc"), "graph_id").join(bootstrap_threshold(cv, perms, reps, seed + 2), "graph_id")


def gradient_argmax(mean: DataFrame, keys: list[str]) -> DataFrame:
    """Where the curve (p_idx, p, lcc) rises most: central differences, one-sided at the ends, the first of equals. Of fewer than three points the highest."""
    w, every = Window.partitionBy(*keys).orderBy("p_idx"), Window.partitionBy(*keys)
    lo, hi = (lambda c: F.coalesce(F.lag(c).over(w), F.col(c))), (lambda c: F.coalesce(F.lead(c).over(w), F.col(c)))
    g = mean.withColumn("g", F.when(F.count("*").over(every) < 3, F.col("lcc")).otherwise((hi("lcc") - lo("lcc")) / (hi("p") - lo("p"))))
    best = g.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("g", 12).desc(), "p_idx"))).withColumn("top", F.max("p_idx").over(every)).where("r = 1")
    return best.select(*keys, F.col("p").alias("pc"), ((F.col("p_idx") == 0) | (F.col("p_idx") == F.col("top"))).alias("boundary"))


def threshold(cv: DataFrame) -> DataFrame:
    return gradient_argmax(cv.groupBy("graph_id", "p_idx", "p").agg(F.avg("lcc").alias("lcc")), ["graph_id"])


def bootstrap_threshold(cv: DataFrame, perms: int, reps: int, seed: int) -> DataFrame:
    """(graph_id, pc_mean, ci_low, ci_high): thresholds of mean curves over permutations drawn with replacement by hash."""
    ids = cv.select("graph_id").distinct()
    draws = ids.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(perms))))
    perm = (F.conv(F.substring(hashed(F.lit(seed), F.col("rep"), F.col("j")), 1, 8), 16, 10).cast("long") % perms + 1).cast("int")
    w = draws.withColumn("perm", perm).groupBy("graph_id", "rep", "perm").agg(F.count("*").alias("k"))
    mean = cv.join(w, ["graph_id", "perm"]).groupBy("graph_id", "rep", "p_idx", "p").agg((F.sum(F.col("lcc") * F.col("k")) / F.sum("k")).alias("lcc"))
    pc = gradient_argmax(mean, ["graph_id", "rep"])
    return pc.groupBy("graph_id").agg(F.avg("pc").alias("pc_mean"), F.percentile("pc", F.lit(0.025)).alias("ci_low"), F.percentile("pc", F.lit(0.975)).alias("ci_high"), F.avg(F.col("boundary").cast("double")).alias("boundary_share"))


def curve_l2(x: DataFrame, y: DataFrame) -> DataFrame:
    """Root mean square difference of two mean curves (graph_id, p_idx, lcc)."""
    j = x.select("graph_id", "p_idx", F.col("lcc").alias("x")).join(y.select("graph_id", "p_idx", F.col("lcc").alias("y")), ["graph_id", "p_idx"])
    return j.groupBy("graph_id").agg(F.sqrt(F.avg(F.pow(F.col("x") - F.col("y"), 2))).alias("l2"))


def fisher_exponent(sizes: DataFrame, lo: int, hi: int) -> DataFrame:
    """Per graph minus the log-log slope of the density of cluster sizes in bins of powers of two within [lo, hi], the largest cluster left out; at least 3 bins."""
    top = sizes.withColumn("r", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.col("size").desc()))).where("r > 1")
    b = top.where(F.col("size").between(lo, hi)).withColumn("bin", F.floor(F.log2("size"))).groupBy("graph_id", "bin").agg(F.count("*").alias("c"))
    b = b.withColumn("x", F.log(F.pow(F.lit(2.0), F.col("bin") + 0.5))).withColumn("y", F.log(F.col("c") / F.pow(F.lit(2.0), F.col("bin"))))
    return b.groupBy("graph_id").agg(F.count("*").alias("bins"), F.when(F.count("*") >= 3, -F.regr_slope("y", "x")).alias("tau"))
