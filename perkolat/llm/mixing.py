"""Mixing sources to target weights by capped water-filling. Native.

Targets share the mix by weight; a source that would exceed its maximum epochs is clamped there and the excess goes to the
others by weight until none is above. Each source then takes whole repetitions of all its documents and one fractional
repetition: documents in the order of a seeded hash until the target is met, the last of them in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small, table, text_of, words, written

WEIGHTS, SHARE, EPOCHS, SEED = (5, 2, 1), 1.5, 2, "mix-1"
#: Hash buckets of a source whose sums find the place where its fractional repetition ends; only that bucket is sorted.
HEX_DIGITS = 3
#: Most sources whose table is broadcast; with more, documents are shuffled to it.
MAX_BROADCAST = 50_000


def water_fill(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """sources(source, source_size), one row each, with weight and target. The k-th source by code point, null last, has the
    k-th weight, repeating. One row for each source is what the unpartitioned windows sort.

    Sources sorted by cap per weight are clamped from the smallest: source j is clamped if its cap is at most its share of
    what the sources before it leave. That is the fixed point of clamping and sharing anew."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    kth = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), kth + 1).cast("double")
    s = sources.withColumn("weight", weight).withColumn("cap", epochs * F.col("source_size").cast("double"))
    rise = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = s.withColumn("mix", share * F.sum("source_size").over(every))
    before = F.coalesce(F.sum("cap").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(rise.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("clamped", F.col("cap") * onward <= F.col("weight") * (F.col("mix") - before))
    left = F.col("mix") - F.coalesce(F.sum(F.when(F.col("clamped"), F.col("cap"))).over(every), F.lit(0.0))
    free = F.sum(F.when(~F.col("clamped"), F.col("weight"))).over(every)
    return s.withColumn("target", F.when(F.col("clamped"), F.col("cap")).otherwise(left / free * F.col("weight"))).drop("mix", "clamped", "cap")


def taken(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """sized(rid, doc_id, source, size) with source_size, target and taken: the words that the mix takes of each row.

    Rows without words and null ids take part like others; equal rows are ordered by rid. The hash depends on seed and
    doc_id alone, so reruns agree. `sized` must be written: it is scanned for sums, bucket sums and the result."""
    h = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = sized.withColumn("h", h).withColumn("bucket", F.substring("h", 1, HEX_DIGITS))
    sums = written(rows.groupBy("source", "bucket").agg(F.sum("size").alias("s")), "mix-sums")
    plan = water_fill(sums.groupBy("source").agg(F.sum("s").alias("source_size")), weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("whole", whole).withColumn("rest", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
    plan = plan.withColumnRenamed("source", "src")
    ends = Window.partitionBy("source").orderBy("bucket")
    upto = sums.withColumn("upto", F.sum("s").over(ends)).join(plan, F.col("source").eqNullSafe(F.col("src")))
    cut = upto.where((F.col("upto") - F.col("s") < F.col("rest")) & (F.col("upto") >= F.col("rest")))  # at most one for each source
    cut = cut.select("src", F.col("bucket").alias("cut"), (F.col("rest") - F.col("upto") + F.col("s")).alias("in_cut"))
    plan = small(written(plan.join(cut.withColumnRenamed("src", "src2"), F.col("src").eqNullSafe(F.col("src2")), "left").drop("src2"), "mix-plan"), MAX_BROADCAST)
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("src")))
    here = F.col("bucket") == F.col("cut")
    place = Window.partitionBy("source").orderBy("h", "doc_id", "size", "rid")
    out = [*sized.columns, "source_size", "target", "whole"]
    inside = rows.where(here).withColumn("pre", F.sum("size").over(place) - F.col("size"))
    inside = inside.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("in_cut") - F.col("pre"))))
    outside = rows.where(~F.coalesce(here, F.lit(False)))  # no cut: nothing is left to take
    outside = outside.withColumn("extra", F.when(F.col("bucket") < F.col("cut"), F.col("size")).otherwise(0))
    every = inside.select(*out, "extra").unionByName(outside.select(*out, "extra"))
    return every.withColumn("taken", (F.col("whole") * F.col("size") + F.col("extra")).cast("long"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    size = F.size(words(text_of(text_col))).cast("long")
    return written(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size")), "mix-sized")


def mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix with the columns of docs, a row for each repetition. A document that the mix takes in part
    stays if it is taken by half or more. Without words, a document has nothing to take and goes. Documents are known by
    doc_id; rows with the same doc_id and source are decided together, by the most that any of them takes."""
    copies = taken(sized(docs)).where(F.col("size") > 0)
    copies = copies.groupBy("doc_id", "source").agg(F.max(F.round(F.col("taken") / F.col("size")).cast("int")).alias("copies")).where("copies > 0")
    copies = small(written(copies, "mix-copies"), 1_000_000)
    packed = docs.select(F.struct("*").alias("doc"))
    on = packed["doc"]["doc_id"].eqNullSafe(copies["doc_id"]) & packed["doc"]["source"].eqNullSafe(copies["source"])
    joined = packed.join(copies.select("doc_id", "source", "copies"), on).select("doc", F.explode(F.sequence(F.lit(1), "copies")).alias("k"))
    return joined.select("doc.*")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = taken(sized(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken")


SQL = {
    "op2_mix_sources": r"""
WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
      md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2 * source_size::DOUBLE AS cap, 1.5 * sum(source_size::DOUBLE) OVER () AS mix FROM s0),
s2 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre,
      sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward FROM s1),
s3 AS (SELECT *, cap * onward <= weight * (mix - pre) AS clamped FROM s2),
s4 AS (SELECT source, source_size, CASE WHEN clamped THEN cap ELSE (mix - coalesce(sum(cap) FILTER (clamped) OVER (), 0)) / (sum(weight) FILTER (NOT clamped) OVER ()) * weight END AS target FROM s3),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM s4),
r AS (SELECT doc_id, size, h, source_size, target, whole, round(target)::BIGINT - whole * source_size AS rest,
      sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS pre
      FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - pre)))::BIGINT AS taken FROM r""",
}
QUERIES = {"op2_mix_sources": op2_mix_sources}
