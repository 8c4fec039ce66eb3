"""Groups of near-duplicates by exact Jaccard similarity of word shingles.

A text is the set of its shingles' XXH64; equal sets, told by 128 bits, are one class. Sets are not kept: each pass cuts them anew from
the texts. Two sets of the wanted similarity share one of their first n - ceil(0.8 n) + 1 shingles in any order that is the same for all:
here by hash, shingles that many prefixes hold last. Pairs that meet pass the length filter, the positional filter and a count of the
prefix shingles that they share; the rest is verified on the whole sets. In some rounds each class is held against the likeliest of the
leaders of its shingles, others in each round, which joins groups of copies by a row each; then all pairs that meet, are not
yet in one component and whose 1024-bit parity signatures allow it are held against each other, so that no link between components is missed.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perkolat.operators.components import components

from .common import dropped, freed, small, swept, written

#: Least Jaccard similarity as a fraction of integers.
NUM, DEN = 4, 5
#: Prefix shingles of over HOT classes, told from one class in DRAWN, go last in the order, up to HOT_MAX of them, found in ROUNDS
#: passes; this changes the work, not the links.
HOT, DRAWN, HOT_MAX, ROUNDS = 32, 8, 500_000, 3
#: Most rows that are broadcast; more are shuffled. Rounds of one pair a class before all pairs meet. Words of 64 bits of a signature.
MAX_BROADCAST, LEADERS, SIG = 300_000, 6, 16


def codes_of(words: list[bytes], shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of lower-cased words; fewer words than a shingle has are one."""
    import xxhash

    if not words:
        return np.empty(0, np.int64)
    joined, k = b" ".join(words), min(shingle, len(words))
    ends = list(itertools.accumulate(map(len, words), lambda a, x: a + x + 1))
    h = xxhash.xxh64_intdigest
    starts = [0, *[e + 1 for e in ends[: len(words) - k]]]
    return np.unique(np.fromiter((h(joined[a:b]) for a, b in zip(starts, ends[k - 1 :])), np.uint64, len(starts)).view(np.int64))


def words(x: pa.Scalar) -> list[bytes]:
    return (x.as_py() or b"").lower().split()


def shingles(text: Column, shingle: int) -> Column:
    @F.arrow_udf("array<long>")
    def of(batch: pa.Array) -> pa.Array:
        sets = [codes_of(words(x), shingle) for x in batch.cast(pa.binary())]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *sets])))

    return of(text)


def identity(text: Column, shingle: int) -> Column:
    """128 bits, as hexadecimal digits, of the set of shingles."""

    @F.arrow_udf("string")
    def of(batch: pa.Array) -> pa.Array:
        import xxhash

        return pa.array([xxhash.xxh128_hexdigest(codes_of(words(x), shingle).tobytes()) for x in batch.cast(pa.binary())], pa.string())

    return of(text)


def prefix_size(n):
    return n - (n * NUM + DEN - 1) // DEN + 1


def entries(own: DataFrame, shingle: int, hot: np.ndarray) -> DataFrame:
    """(token, cid, n, pos) for each shingle in the prefix of each class of own(cid, text)."""
    shared = own.sparkSession.sparkContext.broadcast(hot)

    def work(batches):
        last = shared.value
        for batch in batches:
            cids, texts = batch["cid"].to_numpy(), batch["text"].cast(pa.binary())
            for at in range(0, len(cids), 256):
                parts, ns, ps = [], [], []
                for x in texts[at : at + 256]:
                    c = codes_of(words(x), shingle)
                    n, p = len(c), prefix_size(len(c)) if len(c) else 0
                    if len(last) and p:
                        late = last[np.minimum(np.searchsorted(last, c), len(last) - 1)] == c
                        if late.any():
                            c = np.concatenate([c[~late], c[late]])
                    parts.append(c[:p])
                    ns.append(n)
                    ps.append(p)
                pos = np.concatenate([np.arange(p, dtype=np.int32) for p in ps])
                rows = [pa.array(np.concatenate(parts)), pa.array(np.repeat(cids[at : at + 256], ps)), pa.array(np.repeat(np.array(ns, np.int32), ps)), pa.array(pos)]
                yield pa.RecordBatch.from_arrays(rows, ["token", "cid", "n", "pos"])

    return own.select("cid", "text").mapInArrow(work, "token long, cid long, n int, pos int")


def meeting(own: DataFrame, shingle: int) -> DataFrame:
    """The entries whose shingle is in more than one prefix, written."""
    hot, few = np.empty(0, np.int64), own.where(F.pmod(F.xxhash64("cid"), F.lit(DRAWN)) == 0)
    for _ in range(ROUNDS):
        counts = freed(entries(few, shingle, hot).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > HOT // DRAWN), "near-hot")
        new = np.union1d(hot, counts.orderBy(F.desc("n")).limit(HOT_MAX).select("token").toArrow()["token"].to_numpy())
        if len(new) == len(hot) or len(new) > HOT_MAX:
            break
        hot = new
    counts = freed(entries(own, shingle, hot).groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token"), "near-counts")
    return freed(entries(own, shingle, hot).join(counts, "token"), "near-met")


def may_be(x: str, y: str) -> Column:
    """Whether the length and the place of a shared shingle allow the similarity."""
    nx, ny, px, py = F.col(f"{x}n"), F.col(f"{y}n"), F.col(f"{x}pos"), F.col(f"{y}pos")
    need = F.ceil((nx + ny) * NUM / (NUM + DEN))
    return (nx * DEN >= ny * NUM) & (ny * DEN >= nx * NUM) & (F.least(px, py) + F.least(nx - px, ny - py) >= need)


def counted(pairs: DataFrame) -> DataFrame:
    """(a, b, c) of pairs(a, b, na, nb), a row for each shared prefix shingle, that share enough of them, c: what lies after the prefix
    that ends first can be shared whole, but no more."""
    need = F.ceil((F.col("na") + F.col("nb")) * NUM / (NUM + DEN))
    rest = F.greatest(*(F.ceil(F.col(n) * NUM / DEN) - 1 for n in ("na", "nb")))
    return pairs.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c")).where(F.col("c") + rest >= need).select("a", "b", "c")


def verified(pairs: DataFrame, own: DataFrame, shingle: int) -> DataFrame:
    """Those of pairs(a, b), written, that are similar, written."""
    ids = freed(pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct(), "near-ids")
    wanted = written(own.join(small(ids, MAX_BROADCAST), "cid", "left_semi"), "near-wanted")
    sets = written(wanted.select("cid", shingles(F.col("text"), shingle).alias("codes")), "near-sets")
    dropped(wanted, ids)
    x, y = sets.alias("x"), sets.alias("y")
    both = F.size(F.array_intersect("x.codes", "y.codes"))
    close = pairs.join(x, F.col("a") == F.col("x.cid")).join(y, F.col("b") == F.col("y.cid"))
    out = freed(close.where(both * (NUM + DEN) >= NUM * (F.size("x.codes") + F.size("y.codes"))).select("a", "b"), "near-links")
    dropped(sets)
    return out


def joined(links: DataFrame) -> DataFrame:
    return written(components(links), "near-components")


def told(df: DataFrame, cc: DataFrame, cid: str, name: str) -> DataFrame:
    """df with the component of a class as `name`: itself, if it has no link."""
    own = small(cc.select(F.col("node").alias("_node"), F.col("component").alias("_comp")), MAX_BROADCAST)
    return df.join(own, F.col(cid) == F.col("_node"), "left").withColumn(name, F.coalesce("_comp", cid)).drop("_node", "_comp")


def contracted(cc: DataFrame, links: DataFrame) -> DataFrame:
    """cc(node, component) after links(a, b) between its components: each two components are one edge, however many links join them."""
    edges = told(told(links, cc, "a", "ca"), cc, "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    merged = joined(edges).withColumnsRenamed({"node": "_old", "component": "_new"})
    nodes = cc.unionByName(merged.select(F.col("_old").alias("node"), F.col("_old").alias("component"))).distinct()
    out = nodes.join(small(merged, MAX_BROADCAST), nodes["component"] == merged["_old"], "left")
    return written(out.select("node", F.coalesce("_new", "component").alias("component")).distinct(), "near-components")


def signatures(own: DataFrame, shingle: int) -> DataFrame:
    """(cid, s0 to s15): the parity of a set's shingles by 1024 classes of their hash; a shingle in one of two sets only can flip one bit."""

    def work(batches):
        for batch in batches:
            rows = np.zeros((batch.num_rows, SIG * 64), np.uint8)
            for i, x in enumerate(batch["text"].cast(pa.binary())):
                rows[i] = np.bincount(codes_of(words(x), shingle) & (SIG * 64 - 1), minlength=SIG * 64) & 1
            bits = np.packbits(rows, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["cid"], *[pa.array(bits[:, k].copy()) for k in range(SIG)]], ["cid", *[f"s{k}" for k in range(SIG)]])

    return own.select("cid", "text").mapInArrow(work, "cid long, " + ", ".join(f"s{k} long" for k in range(SIG)))


def opened(met: DataFrame, cc: DataFrame) -> DataFrame:
    """The entries of shingles that more than one component has, with the component, written."""
    own = freed(told(met.select("token", "cid", "n", "pos"), cc, "cid", "comp"), "near-told")
    open_ = own.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    out = freed(own.join(open_, "token"), "near-open")
    dropped(own)
    return out


def linked(own: DataFrame, shingle: int, first: DataFrame | None = None) -> DataFrame:
    """(node, component) of every class of own(cid, text), sets distinct, that is similar to another. first(a, b), written: pairs found by
    other means, of which the similar ones are joined before any shingles meet."""
    met, cc = meeting(own, shingle), None
    left = met.withColumn("comp", F.col("cid"))
    if first is not None:
        cc = joined(verified(first, own, shingle))
        left = opened(met, cc)
    for k in range(LEADERS):
        swept(own.sparkSession)
        # One leader for each shingle, another in each round: first the least class, then by hash. Each class tries the one it shares most with.
        first = F.col("cid") if k == 0 else F.xxhash64(F.lit(k), "cid")
        lead = left.groupBy("token").agg(F.min(F.struct(first.alias("f"), "cid", "n", "pos", "comp")).alias("l")).select("token", *[F.col(f"l.{c}").alias(f"l_{c}") for c in ("cid", "n", "pos", "comp")])
        stars = left.join(lead, "token").where(F.col("comp") != F.col("l_comp")).where(may_be("", "l_"))
        pairs = counted(stars.select(F.col("l_cid").alias("a"), F.col("cid").alias("b"), F.col("l_n").alias("na"), F.col("n").alias("nb")))
        best = pairs.groupBy("b").agg(F.max(F.struct("c", "a")).alias("m")).select("m.a", "b")
        links = verified(freed(best, "near-best"), own, shingle)
        cc = joined(links) if cc is None else contracted(cc, links)
        left = opened(left, cc)
    sig = small(freed(signatures(own.join(small(freed(left.select("cid").distinct(), "near-ids"), MAX_BROADCAST), "cid", "left_semi"), shingle), "near-sigs"), MAX_BROADCAST)
    left = freed(left.join(sig, "cid"), "near-open")
    x, y = left.alias("x"), left.alias("y")
    n1, n2 = F.col("x.n"), F.col("y.n")
    flips = sum((F.bit_count(F.col(f"x.s{k}").bitwiseXOR(F.col(f"y.s{k}"))) for k in range(SIG)), F.lit(0))
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.cid") < F.col("y.cid")) & (F.col("x.comp") != F.col("y.comp")) & may_be("x.", "y.")
    on = on & (flips <= n1 + n2 - 2 * F.ceil((n1 + n2) * NUM / (NUM + DEN)))
    pairs = x.join(y, on).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
    more = verified(freed(counted(pairs).select("a", "b"), "near-pairs"), own, shingle)
    return contracted(cc, more) if more.limit(1).count() else cc


def later_rows(rows: DataFrame, shingle: int, finder: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(rid): the rows that are not the first of their group. rows(rid, id, tie, key, text), written; by id, nulls last, then tie and rid.
    finder gives pairs(a, b) of likely classes of own(cid, text), which are tried first."""
    order = F.struct(F.col("id").isNull().alias("none"), "id", "tie", "rid").alias("place")
    keyed = rows.select("rid", order, "key")
    firsts = freed(keyed.groupBy("key").agg(F.min("rid").alias("cid")), "near-firsts")
    classed = freed(keyed.join(small(firsts, MAX_BROADCAST), "key").select("rid", "place", "cid"), "near-classes")
    own = rows.join(small(written(classed.where("rid <> cid").select("rid"), "near-copies"), MAX_BROADCAST), "rid", "left_anti").select(F.col("rid").alias("cid"), "text")
    grouped = told(classed, linked(own, shingle, finder and finder(own)), "cid", "g").select("rid", "place", "g")
    best = grouped.groupBy("g").agg(F.min("place").alias("p"), F.count("*").alias("n")).where("n > 1").select("g", F.col("p.rid").alias("best"))
    return freed(grouped.join(small(freed(best, "near-best"), MAX_BROADCAST), "g").where("rid <> best").select("rid"), "near-later")
