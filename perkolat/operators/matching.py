"""Matching of places by name within a block, helped by distance."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perkolat.functions.columns import EARTH_M, great_circle_m, normalised_name
from perkolat.lineage import written

#: Places and centres of a block that meet in one row, and such rows in a task.
PLACES, CENTRES, ROWS = 2048, 4096, 8
#: Longest centre's name whose common subsequences are counted; of a longer one the length alone bounds the similarity.
LONGEST = 256
#: What sums of doubles may be off; candidates so near to the best are all told.
SLACK = 1e-9


def ratio(a: Column, b: Column) -> Column:
    """The Ratcliff-Obershelp similarity of two strings; null counts as empty."""

    @F.arrow_udf("double")
    def of(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x.to_pylist(), y.to_pylist())], pa.float64())

    return of(a, b)


class Centres:
    """A block's centres, or some of them, and their best for one place after the other.

    The blocks that the matcher finds equal are a common subsequence of both names, so the longest one bounds the similarity from above: it
    is counted for all names at once, in bits of words of 64 of the place's characters. The matcher itself reads only names whose bound,
    less the distance, reaches the best score so far; of those beyond 300 km, which differ by name alone, only ones that are no later
    in number than the best or may be more similar."""

    def __init__(self, names: list[str], lon: np.ndarray, lat: np.ndarray, ids: list):
        self.names = sorted(set(names))
        at = {x: i for i, x in enumerate(self.names)}
        self.name = np.array([at[x] for x in names])
        self.lengths = np.array([len(x) for x in self.names])
        self.code = {c: i + 1 for i, c in enumerate(sorted(set("".join(x for x in self.names if len(x) <= LONGEST))))}
        self.letters = np.zeros((min(LONGEST, int(self.lengths.max())), len(self.names)), np.int32)  # 0: no character
        for i, x in enumerate(self.names):
            if len(x) <= LONGEST:
                self.letters[: len(x), i] = [self.code[c] for c in x]
        self.matchers: list[SequenceMatcher | None] = [None] * len(self.names)
        self.lon, self.lat, self.cos = np.radians(lon), np.radians(lat), np.cos(np.radians(lat))
        self.rank = np.empty(len(names), int)
        self.rank[sorted(range(len(ids)), key=lambda i: (ids[i] is None, 0 if ids[i] is None else ids[i]))] = np.arange(len(ids))

    def bounds(self, name: str) -> np.ndarray:
        """The most that the similarity of each distinct name can be."""
        common = np.zeros(len(self.names), int)
        for start in range(0, len(name), 64):
            part = name[start : start + 64]
            mask = np.zeros(len(self.code) + 1, np.uint64)
            for k, c in enumerate(part):
                if c in self.code:
                    mask[self.code[c]] |= np.uint64(1 << k)
            open_ = np.full(len(self.names), (1 << 64) - 1, np.uint64)
            for row in mask[self.letters]:
                hit = open_ & row
                open_ = (open_ + hit) | (open_ - hit)
            common += np.bitwise_count(~open_ & np.uint64((1 << len(part)) - 1))
        common = np.where(self.lengths > LONGEST, np.minimum(self.lengths, len(name)), common)
        total = self.lengths + len(name)
        return np.where(total > 0, 2.0 * common / np.maximum(total, 1), 1.0)

    def similarity(self, name: str, k: int) -> float:
        if self.matchers[k] is None:
            self.matchers[k] = SequenceMatcher(None, "", self.names[k])
        self.matchers[k].set_seq1(name)
        return self.matchers[k].ratio()

    def best(self, name: str, lon: float, lat: float) -> list[tuple[int, float]]:
        """(centre, similarity) of those that may have the best score; others have a lower one, or the same and a later number."""
        lon, lat = math.radians(lon), math.radians(lat)
        h = np.sin((self.lat - lat) / 2) ** 2 + self.cos * math.cos(lat) * np.sin((self.lon - lon) / 2) ** 2 if math.isfinite(lon) and math.isfinite(lat) else np.full(len(self.name), np.nan)
        km = 2 * EARTH_M / 1000 * np.arcsin(np.sqrt(np.clip(h, 0.0, 1.0)))
        far = ~(km < 300 + 1e-6)  # also where a place is not known
        loss = np.where(far, 0.3, np.minimum(km, 300.0) / 1000)
        bound = self.bounds(name)
        top = bound[self.name] - loss
        seen: dict[int, float] = {}
        best, least, found = -np.inf, None, []  # least: (similarity, rank) of the best beyond 300 km

        def tried(i: int) -> None:
            nonlocal best, least
            k = int(self.name[i])
            if far[i] and least is not None and bound[k] <= least[0] and self.rank[i] > least[1]:
                return
            if k not in seen:
                seen[k] = self.similarity(name, k)
            s = seen[k]
            if far[i] and (least is None or (s, -self.rank[i]) > (least[0], -least[1])):
                least = (s, int(self.rank[i]))
            found.append((i, s))
            best = max(best, s - loss[i])

        tried(int(np.argmax(top)))
        some = np.flatnonzero(top >= best - SLACK)
        for i in some[np.lexsort((self.rank[some], -top[some]))].tolist():
            if top[i] < best - SLACK:
                break
            tried(i)
        return [(i, s) for i, s in dict(found).items() if s - loss[i] >= best - SLACK and not (far[i] and (s < least[0] or s == least[0] and self.rank[i] > least[1]))]


def chunked(df: DataFrame, name: str, size: int) -> DataFrame:
    """(block, rows): the rows of each block in arrays of about `size`, written."""
    own = written(df.where("block is not null").withColumn("rid", F.monotonically_increasing_id()), name)
    parts = own.groupBy("block").agg(F.ceil(F.count("*") / size).alias("parts"))
    dealt = own.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")))
    return written(dealt.groupBy("block", "part").agg(F.collect_list(F.struct(*[c for c in own.columns if c not in ("block", "rid")])).alias(name)).select("block", name), name)


def candidates(p: DataFrame, c: DataFrame) -> DataFrame:
    """(id, p_lon, p_lat, centre, c_lon, c_lat, similarity): for each place those centres of its block that may be its best.
    Arrays of places meet arrays of centres, each two of a block in a row of its own, dealt evenly over the tasks."""
    kinds = dict(p.dtypes) | dict(c.dtypes)
    met = written(chunked(p, "places", PLACES).join(chunked(c, "centres", CENTRES), "block").select("places", "centres"), "name-pairs")
    met = met.repartition(max(met.sparkSession.sparkContext.defaultParallelism, met.count() // ROWS))
    real = lambda x: np.array([np.nan if v is None else v for v in x], float)

    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                here, there = (dict(zip(v.type.names, v.flatten())) for v in (batch["places"][row].values, batch["centres"][row].values))
                lists = {k: v.to_pylist() for k, v in here.items()}
                own = Centres([x or "" for x in there["c_name"].to_pylist()], real(there["c_lon"].to_pylist()), real(there["c_lat"].to_pylist()), there["centre"].to_pylist())
                i, j, similar = [], [], []
                for k, (name, lon, lat) in enumerate(zip(lists["p_name"], real(lists["p_lon"]).tolist(), real(lists["p_lat"]).tolist())):
                    for at, s in own.best(name or "", lon, lat):
                        i.append(k), j.append(at), similar.append(s)
                cols = {n: here[n].take(pa.array(i, pa.int64())) for n in ("id", "p_lon", "p_lat")} | {n: there[n].take(pa.array(j, pa.int64())) for n in ("centre", "c_lon", "c_lat")}
                yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(similar, pa.float64())], [*cols, "similarity"])

    schema = ", ".join(f"{n} {kinds[n]}" for n in ("id", "p_lon", "p_lat", "centre", "c_lon", "c_lat"))
    return met.mapInArrow(work, schema + ", similarity double")


def blocked_name_match(places: DataFrame, centres: DataFrame) -> DataFrame:
    """places(id, block, name, lon, lat) each with the best centre(centre, block, name, lon, lat) of its block: similarity of the normalised
    names less a thousandth for each kilometre up to 300; of equals the least centre. Places of blocks without centres are kept, unmatched.

    All pairs of one block are bounded, few are compared (Centres); a block's work is the product of its places and centres, spread over
    the cluster in pieces."""
    p = places.select("id", "block", normalised_name(F.col("name")).alias("p_name"), F.col("lon").alias("p_lon"), F.col("lat").alias("p_lat"))
    c = centres.select("centre", "block", normalised_name(F.col("name")).alias("c_name"), F.col("lon").alias("c_lon"), F.col("lat").alias("c_lat"))
    km = great_circle_m(F.col("p_lon"), F.col("p_lat"), F.col("c_lon"), F.col("c_lat")) / 1000
    met = candidates(p, c).select("id", "centre", "similarity", km.alias("km"))
    score = F.round(F.col("similarity") - F.least(F.col("km"), F.lit(300.0)) / 1000, 12)
    best = met.groupBy("id").agg(F.max(F.struct(score.alias("score"), (-F.col("centre")).alias("minus"), "similarity", "km")).alias("m"))
    status = F.when((F.col("similarity") < 0.70) | (F.col("km") > 75), "manual_check_required").when((F.col("similarity") < 0.85) | (F.col("km") > 50), "review").otherwise("high_confidence")
    told = best.select("id", (-F.col("m.minus")).alias("centre"), F.col("m.similarity").alias("similarity"), F.col("m.km").alias("km"), F.col("m.score").alias("score")).withColumn("status", status)
    return places.select("id").join(told, "id", "left").withColumn("status", F.coalesce("status", F.lit("no_candidate")))
