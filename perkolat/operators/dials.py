"""Dials: chains of degree-preserving swaps on one spatial graph that add crossings, or none, step by step. One task holds one chain."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import ChordGrid, crosses


class Chain:
    """A graph's edges under swaps, with the grid that tells crossings."""

    def __init__(self, pdf: pd.DataFrame, seed: int):
        ends = pd.concat([pdf[["a", "ax", "ay"]].set_axis(["node", "x", "y"], axis=1), pdf[["b", "bx", "by"]].set_axis(["node", "x", "y"], axis=1)]).drop_duplicates("node").sort_values("node")
        self.ids, self.xy = ends["node"].to_numpy(), ends[["x", "y"]].to_numpy(float)
        at = {v: i for i, v in enumerate(self.ids.tolist())}
        self.edges = [tuple(sorted((at[a], at[b]))) for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist())]
        self.have, self.grid = set(self.edges), ChordGrid(self.xy, self.edges)
        self.rng, self.accepted = np.random.default_rng(seed), 0

    def neighbour(self, i: int) -> int:
        """An edge from the cells around edge i, or any if there is none."""
        near = set()
        for x, y in self.grid.cover(self.edges[i]):
            for dx in range(-2, 3):
                for dy in range(-2, 3):
                    near |= self.grid.cells.get((x + dx, y + dy), set())
        near.discard(self.edges[i])
        if not near:
            return int(self.rng.integers(len(self.edges)))
        chosen = sorted(near)[int(self.rng.integers(len(near)))]
        return self.place[chosen]

    def index(self) -> None:
        self.place = {e: i for i, e in enumerate(self.edges)}

    def swap(self, i: int, j: int, fits, cap: int) -> float | None:
        """Swap edges i and j if fits(crossings of either new chord), which may be told as `cap` or more where there are so many; the change
        in crossings, as far as these were counted, else None."""
        old = (self.edges[i], self.edges[j])
        (a, b), (c, d) = old
        if len({a, b, c, d}) < 4:
            return None
        new = [tuple(sorted(e)) for e in (((a, c), (b, d)) if self.rng.random() < 0.5 else ((a, d), (b, c)))]
        if new[0] in self.have or new[1] in self.have:
            return None
        n = [self.grid.crossed(e, cap, skip=old) for e in new]
        both = crosses(self.grid.xy, *new)
        if not fits(n[0] + both, n[1] + both):
            return None
        for e in old:
            self.grid.drop(e)
        gone = sum(self.grid.crossed(e) for e in old) + crosses(self.grid.xy, *old)
        for e in new:
            self.grid.put(e)
        self.have -= set(old)
        self.have |= set(new)
        self.edges[i], self.edges[j] = new
        self.place.pop(old[0], None), self.place.pop(old[1], None)
        self.place[new[0]], self.place[new[1]] = i, j
        self.accepted += 1
        return sum(n) + both - gone

    def table(self, **columns) -> pd.DataFrame:
        e = np.array(self.edges).reshape(-1, 2)
        return pd.DataFrame({"a": self.ids[e[:, 0]], "b": self.ids[e[:, 1]], "swaps": self.accepted, **columns})


ARMS = {"noncross": lambda n1, n2: not n1 and not n2, "cross": lambda n1, n2: bool(n1 or n2)}


def matched(pdf: pd.DataFrame, arm: str, fractions: list[float], seed: int, tries: int = 400) -> list[pd.DataFrame]:
    """The edges after round(fraction m) accepted swaps in all, for rising fractions: new chords cross nothing, or one at least does."""
    chain, out = Chain(pdf, seed), []
    chain.index()
    m = len(chain.edges)
    for f in fractions:
        goal, left = round(f * m), tries * max(round(f * m) - chain.accepted, 1)
        while chain.accepted < goal and left > 0 and m > 1:
            left -= 1
            i, j = chain.rng.integers(0, m, 2).tolist()
            if i != j:
                chain.swap(i, j, ARMS[arm], 1)
        out.append(chain.table(stage=f))
    return out


def targeted(pdf: pd.DataFrame, increments: list[float], seed: int, tries: int = 20_000, most: int = 3) -> list[pd.DataFrame]:
    """The edges as crossings per edge rise by each increment over the start: both new chords cross 1 to `most` others, partners are
    neighbours but for every eighth. Ends early when a stage's tries are spent."""
    chain, out = Chain(pdf, seed), []
    chain.index()
    m, added = len(chain.edges), 0.0
    out.append(chain.table(stage=0.0))
    for inc in increments:
        left = tries
        while added / m < inc and left > 0 and m > 1:
            left -= 1
            i = int(chain.rng.integers(m))
            j = int(chain.rng.integers(m)) if left % 8 == 0 else chain.neighbour(i)
            if i != j:
                added += chain.swap(i, j, lambda n1, n2: 1 <= n1 <= most and 1 <= n2 <= most, most + 1) or 0
        out.append(chain.table(stage=inc))
        if left == 0:
            break
    return out


def chains(chords: DataFrame, arms: list[str], stages: list[float], seed: int) -> DataFrame:
    """(graph_id, arm, stage, swaps, a, b): the edges of every arm of every graph at every stage; arm 'target' is the one by crossings."""
    kind = dict(chords.dtypes)["graph_id"]

    def work(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b"])
        made = targeted(pdf, stages, seed) if key[1] == "target" else matched(pdf, key[1], stages, seed)
        out = pd.concat(made)
        return out.assign(graph_id=key[0], arm=key[1])[["graph_id", "arm", "stage", "swaps", "a", "b"]]

    own = chords.select("graph_id", "a", "b", "ax", "ay", "bx", "by").withColumn("arm", F.explode(F.array(*map(F.lit, arms))))
    return own.groupBy("graph_id", "arm").applyInPandas(work, f"graph_id {kind}, arm string, stage double, swaps long, a long, b long")
