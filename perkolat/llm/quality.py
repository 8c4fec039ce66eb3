"""Quality rules as a short-circuit cascade. Native: every figure and verdict is a column expression of the row.

The order of the cascade is chosen from a written sample of all partitions and lengths: each rule's cost is the least time of some runs
there, less that of a run without rules, its selectivity the share it rejects, and rules run by rejection per cost. The verdict is the
same for every order; only the work differs.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, table, text_of, words, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Words of a block in which distinct words are counted: over whole texts their share would fall with length.
BLOCK = 200
#: Rows of the sample, in the mean, and runs of each rule on it.
SAMPLE_ROWS, RUNS = 500, 3


def longs(c: Column) -> Column:
    return c.cast("long")


def word_chars(text: Column) -> Column:
    return longs(F.length(F.translate(text, SPACES, "")))


def n_symbols(text: Column) -> Column:
    return longs(F.length(text) - F.length(F.translate(text, SYMBOLS, "")))


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    both = F.transform(F.array(lines), lambda a: F.size(a) - F.size(F.array_distinct(a)))  # lines are made once
    return longs(F.when(F.instr(text, "\n") > 0, both[0]).otherwise(0))


def window_hashes(ws: Column) -> Column:
    """A 64-bit hash of each window of 8 words, made by doubling: words, pairs, fours, eights."""

    def doubled(step: int):
        def of(h: Column) -> Column:
            ends = F.greatest(F.size(h) - step, F.lit(0))
            return F.zip_with(F.slice(h, F.lit(1), ends), F.slice(h, F.lit(step + 1), ends), lambda a, b: F.xxhash64(a, b))

        return of

    h = F.transform(ws, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        h = F.transform(F.array(h), doubled(step))[0]  # h is bound to a variable, so that it is not made for each use
    return h


def covered(hashes: Column) -> Column:
    """Words that lie in a window found twice or more, from the hashes of the windows in order."""

    def of(h: Column) -> Column:
        at = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.transform(F.array(at), _repeated)[0]

    def _repeated(s: Column) -> Column:
        n = F.size(s)
        same = F.zip_with(F.slice(s, F.lit(1), n - 1), F.slice(s, F.lit(2), n - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        at = F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))
        return F.transform(F.array(at), _length)[0]

    def _length(p: Column) -> Column:
        n = F.size(p)
        gaps = F.zip_with(F.slice(p, F.lit(1), n - 1), F.slice(p, F.lit(2), n - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(WINDOW), lambda a, x: a + x)

    return F.transform(F.array(hashes), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(of(h)))[0]


def distinct_words(ws: Column) -> Column:
    """Distinct words of each block of BLOCK words, summed."""
    return F.transform(F.array(ws), lambda w: F.aggregate(F.sequence(F.lit(0), F.floor(F.greatest(F.size(w) - 1, F.lit(0)) / BLOCK).cast("int")), F.lit(0), lambda a, i: a + F.size(F.array_distinct(F.slice(w, i * BLOCK + 1, F.lit(BLOCK))))))[0]


@dataclass(frozen=True)
class Rule:
    """A document is rejected where `rejects` is true (null: not). `rejects` reads `text` and `ws`, its words."""

    name: str
    rejects: Column


def rules(text: Column, ws: Column, repeat_words: Column | None = None) -> list[Rule]:
    """The production rules. Shares are of words or of the characters in words; each is strict, so that a tie stays.
    repeat_words: that figure, where it is a column already."""
    repeat_words = covered(window_hashes(ws)) if repeat_words is None else repeat_words
    n, chars = F.size(ws), F.greatest(word_chars(text), F.lit(1))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}]+", ""))
    return [
        Rule("few_words", n < 20),
        Rule("symbols", n_symbols(text) * 10 > 2 * n),
        Rule("word_length", (chars < 2 * n) | (chars > 15 * n)),
        Rule("letters", letters * 2 < chars),
        # Blocks hold at least as many distinct words as the text: they are counted only where the text has few.
        Rule("distinct_words", (F.size(F.array_distinct(ws)) * 100 < 30 * n) & (distinct_words(ws) * 100 < 30 * n)),
        Rule("dup_lines", n_dup_lines(text) * 2 > F.size(F.split(text, "\n"))),
        Rule("repeats", repeat_words * 100 > 30 * n),
    ]


def ordered(sample: DataFrame, made: Callable[[Column, Column], list[Rule]]) -> list[Rule]:
    """Rules by rejections per second on sample(text, ws), written, most first; ties keep the given order."""
    rules_, rows = made(F.col("text"), F.col("ws")), sample.count()
    if not rows:
        return rules_

    def least(hit: Column) -> tuple[int, float]:
        took, query = [], sample.agg(F.count(F.when(hit, 1)))
        for _ in range(RUNS):  # the first compiles
            began = time.perf_counter()
            n = query.first()[0]
            took.append(time.perf_counter() - began)
        return n, min(took)

    empty = least(F.size("ws") < 0)[1]
    score = []
    for rule in rules_:
        hits, took = least(rule.rejects)
        score.append(hits / rows / max(took - empty, 1e-3))
    return [r for _, r in sorted(zip(score, rules_), key=lambda x: -x[0])]


def verdict(in_order: list[Rule]) -> Column:
    """The name of the first rule that rejects, else null: a CASE, so that later rules are not evaluated after a hit."""
    out = None
    for rule in in_order:
        out = F.when(rule.rejects, rule.name) if out is None else out.when(rule.rejects, rule.name)
    return out


def judge(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, figures: bool = False) -> DataFrame:
    """docs as column `doc` (a struct of all its columns), its text and words, and `rejected_by` (null: kept).
    figures: also n_repeat_words, for every row; else that costly figure is made only where no other rule rejects.

    A null or empty text has no words and is rejected. Rows are judged one by one: ties and repeats do not matter, extra
    columns stay inside `doc`; very long texts are judged whole; an empty table gives no rows. sample_rows bounds, in the mean, the sample that
    orders the cascade; it never changes a verdict."""
    base = docs.select(F.struct("*").alias("doc")).select("doc", text_of(F.col("doc")[text_col]).alias("text"))
    base = base.select("doc", "text", words(F.col("text")).alias("ws"))
    t, ws = F.col("text"), F.col("ws")
    texts = docs.select(text_of(text_col).alias("text"))
    step = max(1, docs.count() // max(1, sample_rows))
    sample = texts.where(F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(step)) == 0)
    order = ordered(written(sample, "rule-sample").withColumn("ws", words(t)), rules)
    if figures:
        base = base.withColumn("n_repeat_words", covered(window_hashes(ws)))
        given = {r.name: r for r in rules(t, ws, F.col("n_repeat_words"))}
        order = [given[r.name] for r in order]
    return base.withColumn("rejected_by", verdict(order))


def keep(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that no rule rejects, with the columns of docs."""
    return judge(docs, text_col).where(F.col("rejected_by").isNull()).select("doc.*")


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    t = F.col("text")
    out = judge(docs, figures=True).select(
        F.col("doc.doc_id").alias("doc_id"), longs(F.size("ws")).alias("n_words"), word_chars(t).alias("word_chars"), n_symbols(t).alias("n_symbols"),
        n_dup_lines(t).alias("n_dup_lines"), longs(F.col("n_repeat_words")).alias("n_repeat_words"), F.col("rejected_by"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & F.col("rejected_by").isNull()).drop("rejected_by")


SQL = {
    "op7_quality_cascade": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS s FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 6, 1))) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM g) WHERE n > 1),
p AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r) GROUP BY rid),
f AS (SELECT doc_id, text, ws, len(ws) AS n, len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
      len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
      coalesce(p.n_repeat_words, 0) AS n_repeat_words, len(string_split(text, chr(10))) AS n_lines,
      len(regexp_replace(text, '[^\p{L}\p{M}\p{N}]+', '', 'g')) AS letters FROM w LEFT JOIN p USING (rid))
SELECT doc_id, n::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (n < 20 OR 100 * n_repeat_words > 30 * n) AS base_failed,
  NOT (n < 20 OR 100 * n_repeat_words > 30 * n OR n_symbols * 10 > 2 * n OR greatest(word_chars, 1) < 2 * n OR greatest(word_chars, 1) > 15 * n
  OR letters * 2 < greatest(word_chars, 1) OR list_sum(list_transform(range(0, greatest(n - 1, 0) // 200 + 1), lambda i: len(list_distinct(ws[i * 200 + 1 : i * 200 + 200])))) * 100 < 30 * n OR n_dup_lines * 2 > n_lines) AS kept
FROM f""",
}
QUERIES = {"op7_quality_cascade": op7_quality_cascade}
