"""Kernels that hold one graph, or one table of a few hundred rows, in a task: chains of swaps, depth-first search, spectra, fits.

Swap chains are sequential by nature; the cluster runs graphs, fractions and replicates side by side.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_graph(edges: DataFrame, fn, schema: str, cols: list[str] = ["a", "b"]) -> DataFrame:  # noqa: B006
    """fn(pdf) of each graph's edges, sorted; its frame gets the graph_id."""
    kind = dict(edges.dtypes)["graph_id"]

    def work(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = fn(pdf.sort_values(["a", "b"]).reset_index(drop=True))
        out.insert(0, "graph_id", key[0])
        return out

    return edges.select("graph_id", *cols).groupBy("graph_id").applyInPandas(work, f"graph_id {kind}, {schema}")


def cut_structure(pdf: pd.DataFrame) -> pd.DataFrame:
    """Bridges, articulation points and edges of the largest biconnected block, by one depth-first search without recursion."""
    adj = defaultdict(list)
    for i, (a, b) in enumerate(zip(pdf["a"], pdf["b"])):
        adj[a].append((b, i))
        adj[b].append((a, i))
    seen, low, clock, bridges, cuts, stack_edges, largest = {}, {}, 0, 0, set(), [], 0
    for root in sorted(adj):
        if root in seen:
            continue
        seen[root] = low[root] = clock = clock + 1
        children, stack = 0, [(root, -1, iter(adj[root]))]
        while stack:
            v, via, it = stack[-1]
            for w, e in it:
                if e == via:
                    continue
                if w not in seen:
                    seen[w] = low[w] = clock = clock + 1
                    stack_edges.append(e)
                    stack.append((w, e, iter(adj[w])))
                    children += v == root
                    break
                if seen[w] < seen[v]:
                    low[v] = min(low[v], seen[w])
                    stack_edges.append(e)
            else:
                stack.pop()
                if stack:
                    u = stack[-1][0]
                    low[u] = min(low[u], low[v])
                    if low[v] >= seen[u]:
                        size = 0
                        while True:
                            size += 1
                            if stack_edges.pop() == via:
                                break
                        largest = max(largest, size)
                        bridges += size == 1
                        if u != root:
                            cuts.add(u)
        if children > 1:
            cuts.add(root)
    m = len(pdf)
    return pd.DataFrame({"m": [m], "bridges": [bridges], "articulation_points": [len(cuts)], "largest_block_share": [largest / m if m else 0.0]})


def nonbacktracking(pdf: pd.DataFrame, steps: int = 160, tol: float = 1e-8) -> pd.DataFrame:
    """Spectral radius of the non-backtracking operator by power iteration, its inverse as a threshold, and the vector's localisation."""
    nodes, at = np.unique(np.concatenate([pdf["a"], pdf["b"]]), return_inverse=True)
    m = len(pdf)
    src, dst = np.concatenate([at[:m], at[m:]]), np.concatenate([at[m:], at[:m]])
    rev = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    x, rho = np.full(2 * m, 1 / np.sqrt(2 * m)), 0.0
    for step in range(1, steps + 1):
        y = np.bincount(dst, x, len(nodes))[src] - x[rev]
        new, norm = float(x @ y), float(np.linalg.norm(y))
        if norm == 0:
            rho = 0.0
            break
        x, done, rho = y / norm, abs(new - rho) <= tol * max(1.0, abs(new)), new
        if done:
            break
    def localisation(w: np.ndarray) -> tuple[float, float, float]:
        """Sum of squares, the largest, and the share of the largest twentieth of weights that sum to one."""
        top = np.sort(w)[::-1]
        return float((w**2).sum()), float(top[0]), float(top[: max(1, int(np.ceil(0.05 * len(top))))].sum())

    x = np.maximum(x, 0.0)
    w = x / max(float(x.sum()), 1e-300)
    node = np.bincount(dst, w, len(nodes))
    node = node / max(float(node.sum()), 1e-300)
    some = node[node > 0]
    out = {"rho": rho, "p_nb": 1 / rho if rho > 1e-12 else None}
    out |= dict(zip(("ipr", "top1", "top5"), localisation(w))) | dict(zip(("node_ipr", "node_top1", "node_top5"), localisation(node)))
    out["node_entropy"] = float(-(some * np.log(some)).sum() / np.log(max(2, len(some))))
    return pd.DataFrame([out | {"steps": step}])


class ChordGrid:
    """Chords by the grid cells that they pass through."""

    def __init__(self, xy: np.ndarray, edges: list[tuple[int, int]]):
        self.xy = [tuple(p) for p in np.asarray(xy, float).tolist()]  # plain floats: chords are met one by one
        med = float(np.median([np.hypot(*(xy[a] - xy[b])) for a, b in edges])) if edges else 1.0
        self.cell = max(2 * med, 1e-4 * float(np.ptp(xy, axis=0).max() if len(xy) else 1.0), 1e-12)
        self.cells: dict[tuple[int, int], set[tuple[int, int]]] = defaultdict(set)
        for e in edges:
            self.put(e)

    def cover(self, e):
        """The cells of a chord, column by column; its height within a column is widened by what rounding can move it."""
        (x0, y0), (x1, y1) = sorted((self.xy[e[0]], self.xy[e[1]]))
        size, low, high = self.cell, min(y0, y1), max(y0, y1)
        first, last = math.floor(x0 / size), math.floor(x1 / size)
        slope = (y1 - y0) / (x1 - x0) if first < last else 0.0
        slack = 1e-9 * size + 1e-15 * (abs(slope) * (abs(x0) + abs(x1) + size) + abs(low) + abs(high))
        for i in range(first, last + 1):
            ya, yb = low, high
            if first < last:
                ya, yb = sorted((y0 + slope * (max(x0, i * size) - x0), y0 + slope * (min(x1, (i + 1) * size) - x0)))
                ya, yb = max(low, ya - slack), min(high, yb + slack)
            for j in range(math.floor(ya / size), math.floor(yb / size) + 1):
                yield i, j

    def put(self, e):
        for c in self.cover(e):
            self.cells[c].add(e)

    def drop(self, e):
        for c in self.cover(e):
            self.cells[c].discard(e)

    def crossed(self, e, cap: int = 10**9, test=None, skip=()) -> int:
        """Chords without a common end, but for those to skip, that e crosses in an inner point (or for which test holds), counted up to
        cap; e is followed cell by cell and no further than needed."""
        (a, b), test, seen, n = e, test or crosses, set(), 0
        for c in self.cover(e):
            for f in self.cells.get(c, ()):
                if f in seen or a in f or b in f or f in skip:
                    continue
                seen.add(f)
                n += test(self.xy, e, f)
                if n >= cap:
                    return n
        return n


def crosses(xy, e, f) -> bool:
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    a, b, c, d = xy[e[0]], xy[e[1]], xy[f[0]], xy[f[1]]
    return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0


#: Chords by midpoint among which a partner is drawn.
NEAREST = 180


def meets(xy, e, f) -> bool:
    """Whether two segments have a point in common: crossing, touching or lying on each other."""
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    a, b, c, d = xy[e[0]], xy[e[1]], xy[f[0]], xy[f[1]]
    apart = any(max(a[k], b[k]) < min(c[k], d[k]) or max(c[k], d[k]) < min(a[k], b[k]) for k in (0, 1))
    return not apart and side(a, b, c) * side(a, b, d) <= 0 and side(c, d, a) * side(c, d, b) <= 0


class Nearest:
    """Points that move within an extent, in grid cells of about a quarter of the `k` that are asked for."""

    def __init__(self, points: np.ndarray, k: int, extent: float):
        self.points, self.k, self.low = points, min(k, len(points)), points.min(axis=0)
        span = float(np.ptp(points, axis=0).max())
        self.cell = max(span / max(1.0, math.sqrt(4 * len(points) / k)), 1e-12)
        self.most = int(extent / self.cell) + 2
        own = defaultdict(list)
        for i, c in enumerate(np.floor((points - self.low) / self.cell).astype(int).tolist()):
            own[tuple(c)].append(i)
        self.cells = {c: np.array(x) for c, x in own.items()}

    def at(self, i: int) -> tuple[int, int]:
        x, y = ((self.points[i] - self.low) / self.cell).tolist()
        return math.floor(x), math.floor(y)

    def move(self, i: int, to: np.ndarray) -> None:
        c = self.at(i)
        self.cells[c] = self.cells[c][self.cells[c] != i]
        self.points[i] = to
        c = self.at(i)
        self.cells[c] = np.append(self.cells.get(c, np.empty(0, int)), i)

    def of(self, i: int, rank: int) -> int:
        """The point of the given rank, from 0, among the k nearest of point i, itself among them."""
        (cx, cy), ring = self.at(i), 1
        while True:
            around = [(x, y) for x in range(cx - ring, cx + ring + 1) for y in range(cy - ring, cy + ring + 1)]
            own = np.concatenate([self.cells[c] for c in around if c in self.cells])
            if ring >= self.most or len(own) >= self.k:
                far = ((self.points[own] - self.points[i]) ** 2).sum(axis=1)
                # Whatever lies beyond the rings is at least so far away, less what rounding can move.
                if ring >= self.most or np.count_nonzero(far < (ring * self.cell * (1 - 1e-9)) ** 2) > rank:
                    return int(own[np.argpartition(far, rank)[rank]])
            ring = min(2 * ring, self.most) if len(own) < self.k else ring + 1


def rewired(pdf: pd.DataFrame, points: pd.DataFrame | None, mode: str, fraction: float, seed: int, bins: int = 8, tol: float = 0.3, tries: int = 60) -> tuple[list, dict]:
    """A chain of double-edge swaps on one graph until round(fraction * m) are accepted or tries are spent. Degrees never change.

    mode: 'degree' any simple swap; 'slots' new chords within tol of the length slots that they replace; 'noncross' besides, new chords
    have no point in common with chords that share no end, and partners are among the NEAREST."""
    rng = np.random.default_rng(seed)
    ids = sorted(set(pdf["a"]) | set(pdf["b"]))
    at = {v: i for i, v in enumerate(ids)}
    edges = [(min(at[a], at[b]), max(at[a], at[b])) for a, b in zip(pdf["a"], pdf["b"])]
    have, m = set(edges), len(edges)
    xy = None if points is None else points.set_index("node").loc[ids, ["x", "y"]].to_numpy(float)
    places = xy.tolist() if xy is not None else None
    size = (lambda e: math.dist(places[e[0]], places[e[1]])) if xy is not None else None
    lengths = np.array([size(e) for e in edges]) if size else np.zeros(m)
    q = np.quantile(lengths, np.linspace(0, 1, bins + 1)).tolist() if m and size else None
    slot = lambda v: min(max(bisect_right(q, v) - 1, 0), bins - 1)
    grid = ChordGrid(xy, edges) if mode == "noncross" else None
    middle = Nearest(xy[np.array(edges).reshape(-1, 2)].mean(axis=1), NEAREST + 1, float(np.ptp(xy, axis=0).max())) if grid and m else None
    goal, moved, attempts, rejected = round(fraction * m), 0, 0, defaultdict(int)
    while moved < goal and attempts < tries * max(goal, 1) and m > 1:
        attempts += 1
        i = int(rng.integers(m))
        if grid:  # a partner among the nearest by midpoint
            j = middle.of(i, int(rng.integers(middle.k)))
        else:
            j = int(rng.integers(m))
        (a, b), (c, d) = edges[i], edges[j]
        if rng.random() < 0.5:
            c, d = d, c
        new = [(min(a, d), max(a, d)), (min(c, b), max(c, b))]
        if i == j or a == d or c == b or new[0] in have or new[1] in have or new[0] == new[1]:
            rejected["simple"] += 1
            continue
        if mode != "degree":
            ok = True
            for e, old in zip(new, (edges[i], edges[j])):
                s = slot(size(old))
                ok &= q[s] * (1 - tol) <= size(e) <= q[s + 1] * (1 + tol)
            if not ok:
                rejected["length"] += 1
                continue
        if grid:
            old = (edges[i], edges[j])
            if any(grid.crossed(e, 1, meets, old) for e in new) or not {*new[0]} & {*new[1]} and meets(grid.xy, *new):
                rejected["crossing"] += 1
                continue
            for e in old:
                grid.drop(e)
            for k, e in zip((i, j), new):
                grid.put(e)
                middle.move(k, xy[list(e)].mean(axis=0))
        have -= {edges[i], edges[j]}
        have |= set(new)
        edges[i], edges[j] = new
        moved += 1
    after = np.array([size(e) for e in edges]) if size else lengths
    tvd = 0.5 * float(np.abs(np.bincount([slot(v) for v in lengths], minlength=bins) - np.bincount([slot(v) for v in after], minlength=bins)).sum()) / m if m and size else 0.0
    return [(ids[a], ids[b]) for a, b in edges], {"m": m, "swaps": moved, "attempts": attempts, "achieved": 2 * moved / m if m else 0.0, "rejected_simple": rejected["simple"], "rejected_length": rejected["length"], "rejected_crossing": rejected["crossing"], "tvd_fixed_bins": tvd}


def null_models(edges: DataFrame, points: DataFrame | None, mode: str, fractions: list[float], reps: int, seed: int) -> DataFrame:
    """(graph_id, fraction, rep, a, b, and the chain's diagnostics): one task for each graph, fraction and replicate; a failed chain
    gives one row with status 'fail' and its error."""
    kind = dict(edges.dtypes)["graph_id"]
    own = edges.select("graph_id", "a", "b") if points is None else edges.join(points.select("graph_id", F.col("node").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay")), ["graph_id", "a"]).join(points.select("graph_id", F.col("node").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by")), ["graph_id", "b"])
    own = own.withColumn("fraction", F.explode(F.array(*map(F.lit, fractions)))).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    given = points is not None

    def work(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b"])
        pts = None
        if given:
            pts = pd.concat([pdf[["a", "ax", "ay"]].set_axis(["node", "x", "y"], axis=1), pdf[["b", "bx", "by"]].set_axis(["node", "x", "y"], axis=1)]).drop_duplicates("node")
        try:
            got, info = rewired(pdf, pts, mode, key[1], seed + 10007 * key[2] + round(key[1] * 1e6))
            out, status, error = pd.DataFrame(got, columns=["a", "b"]), "pass", None
        except Exception as e:  # noqa: BLE001  a failed chain is a result
            out, info, status, error = pd.DataFrame({"a": [None], "b": [None]}), {}, "fail", f"{type(e).__name__}: {e}"
        for c in ("m", "swaps", "attempts", "achieved", "rejected_simple", "rejected_length", "rejected_crossing", "tvd_fixed_bins"):
            out[c] = info.get(c)
        return out.assign(graph_id=key[0], fraction=key[1], rep=key[2], status=status, error=error)

    schema = f"graph_id {kind}, fraction double, rep int, a long, b long, m long, swaps long, attempts long, achieved double, rejected_simple long, rejected_length long, rejected_crossing long, tvd_fixed_bins double, status string, error string"
    return own.groupBy("graph_id", "fraction", "rep").applyInPandas(work, schema)


def isotonic(x: np.ndarray, y: np.ndarray, at: np.ndarray, increasing: bool = True) -> np.ndarray:
    """Pool-adjacent-violators fit of y on x (ties in x are averaged), read by linear interpolation and clipped beyond the ends."""
    xs, inv = np.unique(x, return_inverse=True)
    w = np.bincount(inv).astype(float)
    v = np.bincount(inv, y) / w * (1 if increasing else -1)
    blocks: list[list[float]] = []
    for k in range(len(xs)):
        blocks.append([v[k], w[k], 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    fit = np.concatenate([np.full(int(n), u) for u, _, n in blocks]) * (1 if increasing else -1)
    return np.interp(at, xs, fit)


ALPHAS = np.logspace(-3, 4, 120)


def ridge_loo(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Ridge with medians for missing values and unit variances; the penalty of least leave-one-out error from one SVD. Returns
    leave-one-out predictions, the penalty and the coefficients of the scaled features."""
    x = np.where(np.isfinite(x), x, np.nanmedian(np.where(np.isfinite(x), x, np.nan), axis=0))
    s = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(s > 0, s, 1)
    u, d, vt = np.linalg.svd(z, full_matrices=False)
    c, n, best = y - y.mean(), len(y), None
    for alpha in ALPHAS:
        f = d**2 / (d**2 + alpha)
        lever = (u**2) @ f + 1 / n
        loo = y - (c - u @ (f * (u.T @ c))) / (1 - lever)
        err = float(((loo - y) ** 2).mean())
        if best is None or err < best[0]:
            best = (err, loo, float(alpha), vt.T @ (d / (d**2 + alpha) * (u.T @ c)))
    return best[1], best[2], best[3]


def pca2(x: np.ndarray) -> np.ndarray:
    """Scores on two components of standardised columns; each component's largest loading is positive."""
    s = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(s > 0, s, 1)
    u, d, vt = np.linalg.svd(z, full_matrices=False)
    sign = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)])
    return (u * d * sign)[:, :2]
