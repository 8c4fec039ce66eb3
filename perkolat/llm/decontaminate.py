"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as sequences of words, folded to lower case without punctuation. An item of n words may differ from a passage
of a document by k = floor(n * edit_rate) word edits. It is cut into k + 1 pieces: any such passage holds one of them unchanged.
An Aho-Corasick automaton finds the pieces in whole documents; around each hit Myers' bit-parallel algorithm gives the least
edit distance of the item to any passage there. Items are the query set: they are matched against all documents in blocks of
bounded size, each of which is broadcast.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

EDIT_RATE = 0.2
#: Items of fewer words must be found unchanged: an edit more would make ordinary phrases of them.
SHORT = 8
#: Most characters of the items of one block.
BLOCK_CHARS = 4_000_000
TOKEN = re.compile(r"[^\W_]+")


def folded(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def myers(peq: dict[str, int], n: int, text: list[str]) -> tuple[int, int]:
    """Least edit distance of the pattern to any run of text, and where the first best run ends. peq: bit masks of the pattern's
    words; n: its length, of any size."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    vp, vn, score, best, end = full, 0, n, n, 0
    for i, word in enumerate(text):
        x = peq.get(word, 0) | vn
        d0 = (((x & vp) + vp) ^ vp) | x
        hn = vp & d0
        hp = vn | (full & ~(vp | d0))
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = (hp << 1) & full, (hn << 1) & full
        vn = hp & d0
        vp = hn | (full & ~(hp | d0))
        if score < best:
            best, end = score, i + 1
    return best, end


class Matcher:
    """Items of one block, ready to be looked for."""

    def __init__(self, items: list[tuple[int, str]], edit_rate: float = EDIT_RATE):
        self.items, self.edit_rate = items, edit_rate
        self.automaton = None

    def __getstate__(self):  # the automaton is built on the executors
        return {"items": self.items, "edit_rate": self.edit_rate, "automaton": None}

    def build(self) -> None:
        import ahocorasick

        self.automaton, self.made = ahocorasick.Automaton(), []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in self.items:
            w = folded(text or "")
            n = len(w)
            if not n:
                continue
            k = int(n * self.edit_rate) if n >= SHORT else 0
            peq: dict[str, int] = {}
            for i, x in enumerate(w):
                peq[x] = peq.get(x, 0) | 1 << i
            self.made.append((item_id, n, k, peq))
            for j in range(k + 1):
                a, b = n * j // (k + 1), n * (j + 1) // (k + 1)
                pieces.setdefault(f" {' '.join(w[a:b])} ", []).append((len(self.made) - 1, a))
        for piece, of in pieces.items():
            self.automaton.add_word(piece, (len(piece), of))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, edits, word at which the passage ends) for each item that the text holds, with its least distance."""
        if self.automaton is None:
            self.build()
        if not self.made:
            return []
        w = folded(text)
        joined = f" {' '.join(w)} "
        spaces = list(accumulate(w, lambda a, x: a + len(x) + 1, initial=0))  # where the space before each word is
        near: dict[int, set[int]] = {}
        for end, (length, of) in self.automaton.iter(joined):
            at = bisect_left(spaces, end - length + 1)  # the word at which the piece begins
            for m, a in of:
                near.setdefault(m, set()).add(at - a)
        out = []
        for m, places in near.items():
            item_id, n, k, peq = self.made[m]
            best, upto = (k + 1, 0), -1
            spans: list[list[int]] = []
            for p in sorted(places):  # windows that overlap are searched once
                a, b = max(0, p - k), min(len(w), p + n + k)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            for a, b in spans:
                score, end = myers(peq, n, w[a:b])
                if score < best[0]:
                    best, upto = (score, a + end), a + end
            if best[0] <= k:
                out.append((item_id, best[0], upto))
        return out


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS):
    """The items in blocks of at most block_chars characters (or one item), read through an iterator. Null texts have no words."""
    block, size = [], 0
    for r in benchmark.select(id_col, text_of(text_col)).distinct().orderBy(id_col).toLocalIterator():
        if block and size + len(r[1]) > block_chars:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, edit_rate: float = EDIT_RATE, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, n_words, end_word): a row for each row of docs and item of which it holds a passage within the budget.

    Null and empty texts hold nothing, nor do items without words match; items under SHORT words must be there unchanged; very long texts
    are searched whole, in time linear in their length; rows and items that repeat give the same rows again and one each; of passages of
    equal distance the first counts; other columns are not read; without items or documents the result is empty."""
    spark, out = docs.sparkSession, None
    schema = "doc_id long, item_id long, edits int, n_words int, end_word long"
    for block in blocks(benchmark, text_col="text", block_chars=block_chars):
        shared = spark.sparkContext.broadcast(Matcher(block, edit_rate))

        def work(batches, shared=shared):
            matcher, size = shared.value, {i: len(folded(t or "")) for i, t in shared.value.items}
            for batch in batches:
                rows = [(d, *hit) for d, t in zip(batch["id"].to_pylist(), batch["text"]) for hit in matcher.find(t.as_py() or "")]
                cols = list(zip(*rows)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array([size[i] for i in cols[1]], pa.int32()), pa.array(cols[3], pa.int64())], ["doc_id", "item_id", "edits", "n_words", "end_word"])

        part = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).mapInArrow(work, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def leaks(text: Column, items: list[tuple[int, str]], spark: SparkSession, edit_rate: float = EDIT_RATE) -> Column:
    """Whether the text holds a passage of any item of one block."""
    shared = spark.sparkContext.broadcast(Matcher(items, edit_rate))

    @F.arrow_udf("boolean")
    def of(batch: pa.Array) -> pa.Array:
        return pa.array(np.array([bool(shared.value.find(x.as_py() or "")) for x in batch], bool))

    return of(text)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark passage, with all columns of docs. Null and empty texts stay, as do repeated rows; without
    items all stay; an empty table gives no rows."""
    for block in blocks(benchmark):
        packed = docs.select(F.struct("*").alias("doc"))
        docs = packed.where(~leaks(text_of(packed["doc"]["text"]), block, docs.sparkSession)).select("doc.*")
    return docs


def op1_benchmark_edit_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL: dict[str, str] = {}
QUERIES = {"op1_benchmark_edit_match": op1_benchmark_edit_match}
