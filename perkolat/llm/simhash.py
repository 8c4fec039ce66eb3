"""SimHash near-duplicates by the generalised pigeonhole principle.

Distinct fingerprints are linked if they differ in at most `distance` bits. The 64 bits are grouped into partitions, bits that
go together into the same one. If the thresholds t of the partitions sum to distance - partitions + 1 (-1 skips one), every
linked pair is within t of each other in some partition. Each fingerprint gets its own thresholds, by dynamic programming on
the candidates that each partition and threshold would bring it. It is stored under its value in each partition and probes
all values within its thresholds; what meets under a value is verified on all 64 bits.

Each block of fingerprints that meet gives a spanning forest of its links, never all pairs. Values shared by more
fingerprints than a block holds are split by further pigeonholes over the remaining bits, and where few bits remain into
pairs of blocks, so that no task holds more than two blocks and no link is lost.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perkolat.operators.components import components

from . import neardup
from .common import small, table, text_of, written

SHINGLE, DISTANCE, SEED = 3, 2, 42
#: Fingerprints of the bounded sample on which bits are grouped and candidates estimated; it changes the work, not the links.
SAMPLE = 4096
#: Most distinct fingerprints of a block.
BLOCK = 4096


def fingerprint(words: list[bytes], shingle: int, seed: int = SEED) -> int:
    """Of lower-cased words: bit i is 1 if it is 1 in over half of the shingles' XXH64, repeats included; none: 0."""
    import xxhash

    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = list(itertools.accumulate(map(len, words), lambda a, x: a + x + 1))  # of each word, without the space
    k = min(shingle, len(words))
    starts = [0, *[e + 1 for e in ends[: n - 1]]]
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :])), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def simhash(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long. Null: as empty, fingerprint 0."""

    @F.arrow_udf("long")
    def of(batch: pa.Array) -> pa.Array:
        raw = batch.cast(pa.binary())
        return pa.array(np.array([fingerprint((x.as_py() or b"").lower().split(), shingle) for x in raw], np.uint64).view(np.int64))

    return of(text)


def grouped_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in `parts` groups of near equal size: each takes a free bit and then those that correlate with the group most."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    dev = bits - bits.mean(axis=0)
    norm = np.sqrt((dev**2).sum(axis=0))
    corr = np.abs(dev.T @ dev) / np.maximum(np.outer(norm, norm), 1e-9)
    np.fill_diagonal(corr, 0)
    free, groups = set(range(64)), []
    for k in range(parts):
        size = (len(free)) // (parts - k)
        group = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < size:
            group.append(max(sorted(free), key=lambda b: corr[b, group].sum()))
            free.discard(group[-1])
        groups.append(sorted(group))
    return groups


def mask(bits: list[int]) -> np.uint64:
    return np.uint64(sum(1 << b for b in bits))


def ball(bits: list[int], radius: int) -> np.ndarray:
    """All patterns of at most `radius` of the bits, as masks to flip; for radius -1 none."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in itertools.combinations(bits, r)], np.uint64)


def costs(fps: np.ndarray, groups: list[list[int]], sample: np.ndarray, total: int, distance: int) -> np.ndarray:
    """[fingerprint, partition, t + 1]: rows to probe with plus candidates expected, for t from -1."""
    top = min(distance, max(len(g) for g in groups))
    out = np.zeros((len(fps), len(groups), top + 2))
    for p, g in enumerate(groups):
        m, near = mask(g), np.zeros((len(fps), top + 1))
        values, n = np.unique(sample & m, return_counts=True)
        for at in range(0, len(fps), 512):
            far = np.bitwise_count((fps[at : at + 512, None] & m) ^ values[None, :])
            for t in range(top + 1):
                near[at : at + 512, t] = (far <= t) @ n
        for t in range(top + 1):
            out[:, p, t + 1] = near[:, t] * (total / max(len(sample), 1)) * 0.02 + sum(math.comb(len(g), r) for r in range(t + 1))
    return out


def allocate(cost: np.ndarray, distance: int) -> np.ndarray:
    """Thresholds [fingerprint, partition] of least cost, each at least -1, that sum to distance - partitions + 1."""
    n, parts, width = cost.shape
    need = distance + 1  # of t + 1, over the partitions
    best, choice = np.full((n, need + 1), np.inf), []
    best[:, 0] = 0
    for p in range(parts):
        new, took = np.full((n, need + 1), np.inf), np.zeros((n, need + 1), np.int8)
        for have in range(need + 1):
            for t in range(min(width - 1, have) + 1):
                c = best[:, have - t] + cost[:, p, t]
                better = c < new[:, have]
                new[better, have], took[better, have] = c[better], t
        best = new
        choice.append(took)
    out, have, rows = np.zeros((n, parts), np.int8), np.full(n, need), np.arange(n)
    for p in reversed(range(parts)):
        out[:, p] = choice[p][rows, have] - 1
        have = have - choice[p][rows, have]
    return out


def planned(sample: np.ndarray, total: int, distance: int) -> list[list[int]]:
    """The grouping, with the number of partitions whose thresholds cost least on the sample."""
    tries = [grouped_bits(sample, parts) for parts in range(max(1, min(2, distance)), min(distance + 1, 6) + 1)]
    few = sample[:256]
    return min(tries, key=lambda g: np.take_along_axis(c := costs(few, g, sample, total, distance), (allocate(c, distance) + 1)[:, :, None].astype(int), 2).sum())


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest, as index pairs, of the links between fps: breadth first, each fingerprint once against those not yet reached."""
    if len(fps) == 2:
        return [(0, 1)] if int(fps[0] ^ fps[1]).bit_count() <= distance else []
    left, out = np.arange(len(fps)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            a = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[a]) <= distance
            if near.any():
                got = left[near]
                left = left[~near]
                out += [(int(a), int(b)) for b in got]
                queue += got.tolist()
    return out


def linked(blocks: DataFrame, distance: int) -> DataFrame:
    """(a, b): representatives of linked fingerprints, from blocks(fps, reps)."""

    def work(batches):
        for batch in batches:
            a, b = [], []
            for fps, reps in zip(batch["fps"], batch["reps"]):
                f, r = np.asarray(fps.values).view(np.uint64), np.asarray(reps.values)
                for i, j in forest(f, distance):
                    a.append(r[i])
                    b.append(r[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return blocks.select("fps", "reps").mapInArrow(work, "a long, b long")


def probed(fps: DataFrame, groups: list[list[int]], sample: np.ndarray, total: int, distance: int) -> DataFrame:
    """(part, value, fp, rep, probe): a row for each partition, under the value stored, and for each value probed besides."""
    masks, bits = [mask(g) for g in groups], groups

    def work(batches):
        for batch in batches:
            f_all, r_all = batch["fp"].to_numpy().view(np.uint64), batch["rep"].to_numpy()
            for at in range(0, len(f_all), 1024):
                f, r = f_all[at : at + 1024], r_all[at : at + 1024]
                cost = costs(f, groups, sample, total, distance)
                t = allocate(cost, distance)
                for p, m in enumerate(masks):
                    got = [(f & m, f, r, t[:, p] >= 0)]
                    for k in range(1, int(t[:, p].max()) + 1):
                        own = t[:, p] >= k
                        flips = np.array([sum(1 << b for b in c) for c in itertools.combinations(bits[p], k)], np.uint64)
                        n = int(own.sum())
                        got.append((((f[own] & m)[:, None] ^ flips[None, :]).ravel(), np.repeat(f[own], len(flips)), np.repeat(r[own], len(flips)), np.ones(n * len(flips), bool)))
                    v, ff, rr, pr = (np.concatenate(x) for x in zip(*got))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), p, np.int32)), pa.array(v.view(np.int64)), pa.array(ff.view(np.int64)), pa.array(rr), pa.array(pr)], ["part", "value", "fp", "rep", "probe"])

    return fps.mapInArrow(work, "part int, value long, fp long, rep long, probe boolean")


def links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(a, b): representatives whose fingerprints are linked, enough of them to give all components. fps(fp, rep): distinct, written."""
    spark = fps.sparkSession
    total = fps.count()
    share = min(1.0, 4 * SAMPLE / max(total, 1))
    drawn = fps.where(F.pmod(F.xxhash64("fp"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("fp").limit(SAMPLE).collect()
    sample = np.array(sorted(r[0] for r in drawn), np.int64).view(np.uint64)
    groups = planned(sample, total, distance)
    key = ["part", "value"]
    rows = written(probed(fps, groups, sample, total, distance), "sim-probes")
    found: DataFrame | None = None
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n"), F.max("probe").alias("any")).where("n > 1 and any")
    used = [sum(1 << b for b in g) for g in groups]  # bits equal, or nearly, under a value of each part
    depth = 0
    while True:
        sizes = written(sizes, "sim-sizes")
        met = rows.join(sizes.where(F.col("n") <= block).select(*key), key)
        part = linked(met.groupBy(*key).agg(F.collect_list("fp").alias("fps"), F.collect_list("rep").alias("reps")), distance)
        part = written(part, "sim-links")
        found = part if found is None else found.unionByName(part)
        if sizes.where(F.col("n") > block).limit(1).count() == 0:
            return found
        hot = rows.join(sizes.where(F.col("n") > block), key).select(*key, "fp", "rep", "n")
        depth += 1
        width = (64 - max(bin(u).count("1") for u in used)) // (distance + 1)
        if width < 8:  # few free bits: pairs of blocks
            c = F.ceil(F.col("n") / F.lit(block // 2)).cast("int")
            own = F.pmod(F.xxhash64("fp", F.lit(depth)), c).cast("int")
            pairs = hot.withColumn("c", c).withColumn("own", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
            pairs = pairs.groupBy(*key, F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j")).agg(F.collect_list("fp").alias("fps"), F.collect_list("rep").alias("reps"))
            return found.unionByName(written(linked(pairs, distance), "sim-links"))
        # A value's fingerprints differ in the free bits by at most `distance`, so they agree on one of distance + 1 parts of them.
        cuts = []
        for p, u in enumerate(used):
            free = [b for b in range(64) if not u >> b & 1]
            cuts += [(p, p * (distance + 1) + k, mask(free[k :: distance + 1])) for k in range(distance + 1)]
        signed = lambda m: int(np.uint64(m).astype(np.int64))
        plan = spark.createDataFrame([(p, q, signed(m)) for p, q, m in cuts], "part int, sub int, m long")
        deeper = hot.join(F.broadcast(plan), "part")  # a row for each part, their number fixed by distance and depth
        rows = written(deeper.select(F.col("sub").alias("part"), F.xxhash64("part", "value", F.col("fp").bitwiseAND(F.col("m"))).alias("value"), "fp", "rep").distinct(), "sim-deeper")
        used = [used[p] | int(m) for p, _, m in cuts]
        sizes = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def grouped(fingerprints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, component_id) for each distinct fp of fingerprints(doc_id, fp), written: component_id is the smallest doc_id reachable.
    Null ids count only where a fingerprint has no other; such groups of their own get a null component."""
    fps = written(fingerprints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "sim-fps")
    cc = components(links(fps.where("rep is not null"), distance))
    cc = written(cc, "sim-components")
    return fps.join(cc, fps["rep"] == cc["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp (signed long) and component_id of every row of docs. Null and empty texts have fingerprint 0 and are linked
    like others; equal texts and repeated rows share a component; an empty table gives no rows; other columns are not read."""
    own = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), simhash(text_of(text_col), shingle).alias("fp")), "sim-own")
    return own.join(small(written(grouped(own, distance), "sim-groups"), 500_000), "fp").select("doc_id", "fp", "component_id")


def alike(own: DataFrame, shingle: int, distance: int = DISTANCE) -> DataFrame:
    """(a, b): pairs of own(cid, text) by which all whose fingerprints are linked hang together, written: within `distance` bits a forest of
    the fingerprints' links, and of equal fingerprints the least cid with each other one."""
    rows = written(own.select("cid", simhash(F.col("text"), shingle).alias("fp")), "sim-own")
    fps = written(rows.groupBy("fp").agg(F.min("cid").alias("rep")), "sim-fps")
    same = rows.join(small(fps, 500_000), "fp").where("cid <> rep").select(F.col("rep").alias("a"), F.col("cid").alias("b"))
    near = links(fps, distance).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return written(near.unionByName(same).distinct(), "sim-alike")


def keep_first(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """docs without its near-duplicates: of each group the row with the smallest doc_id stays, with all its columns.

    SimHash finds the links, by fingerprints within DISTANCE bits; an exact check follows: of those links the ones stay whose sets of
    five-word shingles have a Jaccard similarity of 0.8 or more, and pairs of that similarity whose fingerprints lie further apart, as 64
    bits cannot tell 0.8 from 0.7, are added by a prefix join. Rows are told apart by a written number, not by doc_id; a null id is last."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("doc"))
    text = text_of(F.col("doc.text"))
    rows = rows.select("rid", "doc", F.col("doc.doc_id").cast("long").alias("id"), F.xxhash64("doc").alias("tie"), neardup.identity(text, shingle).alias("key"))
    rows = written(rows, "near-rows")
    gone = neardup.later_rows(rows.select("rid", "id", "tie", "key", text.alias("text")), shingle, lambda own: alike(own, shingle))
    return rows.select("rid", "doc").join(small(gone, neardup.MAX_BROADCAST), "rid", "left_anti").select("doc.*")


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SQL: dict[str, str] = {}
QUERIES = {"op9_simhash_groups": op9_simhash_groups}
