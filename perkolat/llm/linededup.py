"""Line dedup by an exact set-similarity join. Native.

A line is the set of its words, letters in lower case; lines of equal sets are one class, whose first line, by doc_id and place, stands
for it. Words are ordered by rarity, and each class is entered under its prefix: the rarest words, so many that two sets of the wanted
Jaccard similarity share one of them. What meets under a word passes the length filter, the positional filter (the words left
after the shared one bound the overlap) and a filter on 64-bit parity signatures before it leaves the join; the rest is verified
word by word. A line goes if an earlier one is at least as similar.

Classes are first held against the earliest class of each of their words alone, which marks groups of near copies by a row each.
Only those not marked then meet all earlier ones, so that no earlier similar line is missed and no group is squared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, freed, small, table, text_of, written

#: Least Jaccard similarity as a fraction of integers.
NUM, DEN = 4, 5
#: A set of fewer words is similar to its equals only: n words in common with n + 1 are too few.
FEW = NUM // (DEN - NUM)
#: Counters by which rarity is told, by the word's hash; any fixed order gives the same pairs, a true one fewer to verify.
COUNTERS = 1 << 17
#: Parts of the words' hashes that the second pass takes one after the other: each shuffles its share of the entries alone.
SLICES = 2
#: Most rows that are broadcast; more are shuffled.
MAX_BROADCAST = 400_000

E_COLS = ["token", "cid", "n", "pos", "sig", "sig2"]


def plain(text: Column) -> Column:
    """The text in lower case, with spaces alone between the words of a line."""
    other = r"[\t\x0b-\r]"  # few texts have any, and splitting at one plain character is faster
    return F.lower(F.when(text.rlike(other), F.regexp_replace(text, other, " ")).otherwise(text))


def lines(text: Column) -> Column:
    return F.split(plain(text), "\n")


def rarity(docs: DataFrame, text_col: str) -> Column:
    """For each counter the logarithm of the words that fall to it, an array of a fixed size that is a constant of the plan."""
    word = docs.select(F.explode(F.split(F.replace(plain(text_of(text_col)), F.lit("\n"), F.lit(" ")), " ")).alias("w")).where("w <> ''")
    counts = word.groupBy(F.hash("w").bitwiseAND(F.lit(COUNTERS - 1)).alias("b")).agg(F.count("*").alias("n"))
    out = [0] * COUNTERS
    for b, n in counts.select("b", F.least(F.floor(F.log2(F.col("n")) * 4), F.lit(126)).cast("int") + 1).collect():
        out[b] = n
    return F.split(F.lit(",".join(map(str, out))), ",").cast("array<int>")


def set_of(line: Column, ranks: Column) -> Column:
    """The set of a line's words, rarest first: for each the counter's value, then 56 bits of its hash."""

    def key(w: Column) -> Column:
        rank = ranks[F.hash(w).bitwiseAND(F.lit(COUNTERS - 1))].cast("long")
        return F.coalesce(F.shiftleft(rank, 56).bitwiseOR(F.shiftrightunsigned(F.xxhash64(w), 8)), F.lit(0).cast("long"))  # never null: arrays of plain longs

    return F.sort_array(F.array_distinct(F.transform(F.array_remove(F.split(line, " "), ""), key)))


def raw_key(line: Column) -> list[Column]:
    """128 bits that tell lines apart."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def lines_of(docs: DataFrame, ranks: Column, id_col: str, text_col: str, rid_col: str | None) -> DataFrame:
    """rid, doc_id, at, h1, h2 (the line), k1, k2 (its set), n (words), two signatures and the prefix for each line with words, written. The
    first line of a document is there in any case, with n = 0 if it has no word."""
    rid = F.col(rid_col) if rid_col else F.monotonically_increasing_id()
    own = docs.select(rid.alias("rid"), F.col(id_col).alias("doc_id"), lines(text_of(text_col)).alias("lines"))
    cut = own.select("rid", "doc_id", F.posexplode("lines").alias("at", "line")).where((F.trim("line") != "") | (F.col("at") == 0))
    keyed = cut.select("rid", "doc_id", "at", *raw_key(F.col("line")), set_of(F.col("line"), ranks).alias("k"))
    # The parity of the words by 128 classes of their hash: words with an even and those with an odd one.
    sig = [F.expr(f"aggregate(k, 0L, (a, c) -> a ^ shiftleft((c & 1) ^ {odd}L, cast(shiftright(c, 1) & 63 AS int)))").alias(name) for name, odd in (("sig", 0), ("sig2", 1))]
    n = F.size("k")
    prefix = F.when(n >= FEW, F.slice("k", F.lit(1), (n - F.ceil(n * NUM / DEN) + 1).cast("int"))).otherwise(F.array().cast("array<bigint>"))
    out = keyed.select("rid", "doc_id", "at", "h1", "h2", F.xxhash64("k").alias("k1"), F.xxhash64(F.lit(1), "k").alias("k2"), n.alias("n"), *sig, prefix.alias("prefix"))
    return freed(out, "line-lines")


def classes(rows: DataFrame) -> DataFrame:
    """(cid, k1, k2, h1, h2, place, copies, n, sig, sig2, prefix) of each set, written; place is its first line's, and cid rises with it."""
    place = F.struct("doc_id", "at", "rid")  # null ids come first
    first = rows.where("n > 0").select("k1", "k2", F.struct(place.alias("place"), "h1", "h2", "n", "sig", "sig2", "prefix").alias("f"))
    found = freed(first.groupBy("k1", "k2").agg(F.min("f").alias("f"), F.count("*").alias("copies")).select("k1", "k2", "copies", "f.*"), "line-found")
    out = freed(found.orderBy("place").select(F.monotonically_increasing_id().alias("cid"), "*"), "line-classes")
    dropped(found)
    return out


def entries(own: DataFrame, part: int) -> DataFrame:
    """(token, cid, n, pos, sig, sig2) for each word in the prefix of each class that falls to a slice of the words."""
    e = own.select("cid", "n", "sig", "sig2", F.posexplode("prefix").alias("pos", "token")).select(*E_COLS)
    return e.where(F.pmod(F.shiftrightunsigned("token", 8), F.lit(SLICES)) == part)


def may_be(a: str, b: str) -> Column:
    """Whether the length, the place of a shared word and the signatures allow the similarity, if it is the first shared word."""
    n1, n2, p1, p2 = F.col(f"{a}n"), F.col(f"{b}n"), F.col(f"{a}pos"), F.col(f"{b}pos")
    need = F.ceil((n1 + n2) * NUM / (NUM + DEN))  # least overlap: so many words of either are left from the shared one on
    return (n1 * DEN >= n2 * NUM) & (n2 * DEN >= n1 * NUM) & (F.least(n1 - p1, n2 - p2) >= need) & (flips(a, b) <= n1 + n2 - 2 * need)


def flips(a: str, b: str) -> Column:
    """Bits in which the signatures differ: each word in one set only can flip one."""
    return F.bit_count(F.col(f"{a}sig").bitwiseXOR(F.col(f"{b}sig"))) + F.bit_count(F.col(f"{a}sig2").bitwiseXOR(F.col(f"{b}sig2")))


def led(own: DataFrame) -> DataFrame:
    """(a, b): for each class of own the likeliest of the earliest classes of its rarest words, written. A row for each class at most."""
    few = own.where(F.size("prefix") > 0).withColumn("prefix", F.slice("prefix", F.lit(1), (F.col("n") - F.ceil(F.col("n") * (2 * NUM) / (NUM + DEN)) + 1).cast("int")))
    parts = []
    for part in range(SLICES):
        e = entries(few, part)
        lead = e.groupBy("token").agg(F.min(F.struct(*E_COLS[1:])).alias("l"), F.count("*").alias("c")).where("c > 1")
        lead = lead.select("token", *[F.col(f"l.{c}").alias(f"l_{c}") for c in E_COLS[1:]])
        met = e.join(lead, "token").where((F.col("cid") > F.col("l_cid")) & may_be("", "l_"))
        best = met.groupBy(F.col("cid").alias("b")).agg(F.min(F.struct(flips("", "l_").alias("f"), F.col("l_cid").alias("a"))).alias("m"))
        parts.append(freed(best, "line-led"))
    return freed(reduce(DataFrame.unionByName, parts).groupBy("b").agg(F.min("m").alias("m")).select("m.a", "b"), "line-led")


def meeting(own: DataFrame, late: DataFrame) -> DataFrame:
    """(a, b, flips): each class that is not late with the earlier ones that pass the filters under a shared word, written."""
    parts = []
    open_ = own.join(late, own["cid"] == late["b"], "left_anti")
    for part in range(SLICES):
        x, y = entries(own, part).alias("x"), entries(open_, part).alias("y")
        on = (F.col("x.token") == F.col("y.token")) & (F.col("x.cid") < F.col("y.cid")) & may_be("x.", "y.")
        pairs = x.join(y, on).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"), flips("x.", "y.").alias("flips"))
        parts.append(freed(pairs.distinct(), "line-pairs"))
    return freed(reduce(DataFrame.unionByName, parts).distinct(), "line-pairs")


def sets(pairs: DataFrame, own: DataFrame, docs: DataFrame, ranks: Column, text_col: str) -> DataFrame:
    """(cid, k): the sets of the classes of pairs(a, b), cut anew from the texts for these classes alone, written."""
    ids = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    wanted = small(freed(own.join(ids, "cid", "left_semi").select("cid", "h1", "h2"), "line-wanted"), MAX_BROADCAST)
    cut = docs.select(F.explode(lines(text_of(text_col))).alias("line")).select("line", *raw_key(F.col("line")))
    own_lines = cut.join(wanted, ["h1", "h2"]).groupBy("cid").agg(F.min("line").alias("line"))
    return freed(own_lines.select("cid", set_of(F.col("line"), ranks).alias("k")), "line-sets")


def verified(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """(b) of each of the pairs (a, b) that are similar word by word, written. own(cid, k)."""
    x, y = own.alias("x"), own.alias("y")
    both = F.size(F.array_intersect("x.k", "y.k"))
    close = pairs.join(x, F.col("a") == F.col("x.cid")).join(y, F.col("b") == F.col("y.cid"))
    return freed(close.where(both * (NUM + DEN) >= NUM * (F.size("x.k") + F.size("y.k"))).select("b").distinct(), "line-late")


def later(own: DataFrame, docs: DataFrame, ranks: Column, text_col: str) -> DataFrame:
    """(b): the classes to which an earlier one is similar. Second-pass classes first try the one of the nearest signature; only
    those that fail are held against all the others."""
    pairs = led(own)
    late = verified(pairs, sets(pairs, own, docs, ranks, text_col))
    pairs = meeting(own, small(late, MAX_BROADCAST))
    k = sets(pairs, own, docs, ranks, text_col)
    nearest = pairs.groupBy("b").agg(F.min(F.struct("flips", "a")).alias("m")).select("b", "m.a")
    more = verified(nearest, k)
    rest = pairs.select("a", "b").join(small(more, MAX_BROADCAST), "b", "left_anti")
    return late.unionByName(more).unionByName(verified(rest, k))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rid_col: str | None = None) -> DataFrame:
    """rid, doc_id, n_lines (with words), n_removed and their places, a row for each row of docs.

    Null and empty texts have no line. Very long texts are many lines, a very long line is one set; nothing is cut. Rows that repeat
    are told apart by rid, their place in the input or the number in rid_col: the later ones lose their lines. Null ids come first. Ties
    do not arise, as places differ; other columns are not read; an empty table gives no rows."""
    ranks = rarity(docs, text_col)
    full = lines_of(docs, ranks, id_col, text_col, rid_col)
    own = classes(full)
    rows = written(full.select("rid", "doc_id", "at", "n", "k1", "k2"), "line-rows")
    dropped(full)
    late = later(own, docs, ranks, text_col).distinct().withColumn("late", F.lit(True))
    told = own.join(small(freed(late, "line-later"), MAX_BROADCAST), F.col("cid") == F.col("b"), "left").where("late or copies > 1")
    told = small(freed(told.select("k1", "k2", "place", F.coalesce("late", F.lit(False)).alias("late")), "line-told"), MAX_BROADCAST)
    joined = rows.join(told, ["k1", "k2"], "left")
    other = ~F.struct("doc_id", "at", "rid").eqNullSafe(F.col("place"))
    gone = (F.col("n") > 0) & F.col("late").isNotNull() & (F.col("late") | other)
    per = joined.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.count_if(F.col("n") > 0).alias("n_lines"), F.sort_array(F.collect_list(F.when(gone, F.col("at")))).alias("removed_lines"))
    return per.select("rid", "doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines")


def cleaned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the removed lines taken out of the text; all other columns as they are. The rows are written with their numbers, so that
    both scans agree on them."""
    rows = written(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("doc")), "line-rows")
    own = rows.select("rid", F.col("doc.doc_id").alias("doc_id"), F.col("doc")[text_col].alias("text"))
    gone = dedup(own, text_col="text", rid_col="rid").where("n_removed > 0").select("rid", "removed_lines")
    kept = F.array_join(F.filter(F.split(F.col("doc")[text_col], "\n"), lambda x, i: ~F.array_contains("removed_lines", i)), "\n")
    out = rows.join(gone, "rid", "left")
    return out.select(F.when(F.col("removed_lines").isNull(), F.col("doc")).otherwise(F.col("doc").withField(text_col, kept)).alias("doc")).select("doc.*")


def op3_line_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("rid")


SQL: dict[str, str] = {}
QUERIES = {"op3_line_similarity": op3_line_similarity}
