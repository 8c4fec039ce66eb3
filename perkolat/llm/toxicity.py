"""Toxicity by a weighted lexicon.

Texts are folded: compatible and accented forms to plain letters, invisible characters out, lower case, look-alike letters to the Latin
ones, signs and digits inside words to the letters that they stand for, other punctuation to spaces. The lexicon holds words and
stems with weights, learned from labelled rows of the training folds by their log-odds; an Aho-Corasick automaton finds them in
whole texts. Words that a stem covers but that only clean texts hold are exceptions, as are phrases of a hit and the word beside
it that only clean texts hold, and phrases given; hits inside an exception do not count. Two figures for the length of the text, the weight
and the different terms, give the score by a logistic curve.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of, written

#: Most labelled rows that the lexicon and the curve are learned from, drawn by a hash of doc_id.
MAX_ROWS = 20_000
STEMS = range(4, 9)
#: Least likelihood ratio (G squared) of a term with the label, and least clean texts that hold an exception phrase.
LEAST_G2, LEAST_CLEAN = 16.0, 3
#: Words that every text counts as having besides its own, so that one hit in a short text is no certainty.
GRACE = 30
#: Letters of other scripts that look like Latin ones, and digits or signs written for letters.
HOMOGLYPHS = dict(zip("абвеёзікмнорстухѕјԁӏһԛԝαβγεζηικμνορτυχωօսոց", "abbeezikmhopctyxsjdlhqwabyezhikmvoptuxwouno"))
DIGITS = dict(zip("013457", "oieast"))
SIGNS = dict(zip("@$!|", "asil"))
FOLD = str.maketrans(HOMOGLYPHS | {c: " " for c in "\n\t\r\x0b\x0c.,;:?\"'()[]{}<>*#%&=+-_/\\~^`"} | DIGITS)
#: A sign is a letter before a letter or another such sign that is (b@d, $hit, a$$hat), and $ after one; at a word's end the others are signs.
SIGN = re.compile(r"(?<=\w)[!|](?=\w)|[@$]++(?=\w)|(?<=\w)\$++")
LATIN = re.compile(r"(?:LATIN|REGIONAL INDICATOR).*\bLETTER (?:SMALL CAPITAL )?([A-Z])(?: WITH .*)?$")


@lru_cache(maxsize=100_000)
def plain(c: str) -> str:
    """A character that is not ASCII without its marks, as the Latin letter that its name says, or nothing if it is invisible."""
    kind = unicodedata.category(c)
    if kind in ("Mn", "Me", "Cf"):
        return ""
    if kind[0] == "Z":
        return " "
    m = LATIN.search(unicodedata.name(c, ""))
    return m[1].lower() if m else c.lower() if kind[0] == "L" else " "


def folded(text: str) -> str:
    """With a space before and after. A run of digits alone folds too; no term is made of it, as clean texts hold numbers."""
    if not text.isascii():
        text = "".join([c if c < "\x80" else plain(c) for c in unicodedata.normalize("NFKD", text)])
    text = SIGN.sub(lambda m: "".join(SIGNS[c] for c in m[0]), text.lower())
    return f" {text.translate(FOLD).replace('!', ' ').replace('|', ' ').replace('@', ' ').replace('$', ' ')} "


def terms(text: str) -> set[str]:
    """The words of a folded text as ' word ' and their stems as ' stem'."""
    out = set()
    for w in set(text.split()):
        if len(w) > 2:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in STEMS if len(w) >= k)
    return out


def counted(labelled: DataFrame) -> DataFrame:
    """(term, pos, neg): labelled rows(text, toxic) of either label that hold the term."""

    def work(batches):
        pos, neg = Counter(), Counter()

        def out():
            keys = list(pos.keys() | neg.keys())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], ["term", "pos", "neg"])

        for batch in batches:
            for t, y in zip(batch["text"], batch["toxic"].to_pylist()):
                (pos if y else neg).update(terms(folded(t.as_py() or "")))
                if len(pos) + len(neg) > 500_000:
                    yield out()
                    pos.clear()
                    neg.clear()
        yield out()

    return labelled.select("text", "toxic").mapInArrow(work, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def g2(pos: int, neg: int) -> Column:
    """The likelihood ratio of columns pos and neg of pos and neg texts."""
    p, n = F.col("pos").cast("double"), F.col("neg").cast("double")
    share = (p + n) / (pos + neg)
    part = lambda a, b: F.when((a > 0) & (b > 0), 2 * a * F.log(a / b)).otherwise(0.0)
    return part(p, pos * share) + part(n, neg * share) + part(pos - p, pos * (1 - share)) + part(neg - n, neg * (1 - share))


def lexicon(counts: DataFrame, pos: int, neg: int) -> tuple[dict[str, float], list[str]]:
    """Terms with weights, and words that are exceptions. A term that an accepted stem covers is left out, unless it is stronger. What is
    collected is of the bounded sample's vocabulary, and significant."""
    share = pos / max(pos + neg, 1)
    likely = counts.where(F.col("pos") >= 3).where(F.col("pos") > F.lit(2 * share) * (F.col("pos") + F.col("neg"))).withColumn("g", F.round(g2(pos, neg), 6)).where(F.col("g") >= LEAST_G2)
    scored = sorted(((r["g"], r["pos"], r["neg"], r["term"]) for r in likely.collect()), key=lambda x: (-x[0], -len(x[3].rstrip()), x[3].endswith(" "), x[3]))
    taken: dict[str, float] = {}
    begun: set[str] = set()  # all beginnings of the terms taken
    for _, p, n, term in scored:
        if term not in begun and not any(term[:k] in taken for k in range(1, len(term))):
            taken[term] = max(0.1, math.log((p + 0.5) / (pos + 1)) - math.log((n + 0.5) / (neg + 1)))
            begun.update(term[:k] for k in range(1, len(term) + 1))
    covered = F.lit(False)
    for k in STEMS:
        if own := [t for t in taken if len(t) == k + 1 and not t.endswith(" ")]:
            covered = covered | F.substring("term", 1, k + 1).isin(own)
    exceptions = counts.where((F.col("pos") == 0) & F.col("term").endswith(" ") & covered)
    return taken, [r[0] for r in exceptions.select("term").orderBy("term").collect()]


def phrases(labelled: DataFrame, made: Scorer) -> list[str]:
    """Phrases of the word that holds a hit and the one before or after it that LEAST_CLEAN clean texts hold and no toxic one."""

    def work(batches):
        for batch in batches:
            pos, neg = Counter(), Counter()
            for t, y in zip(batch["text"], batch["toxic"].to_pylist()):
                text = folded(t.as_py() or "")
                (pos if y else neg).update(made.beside(text))
            keys = list(pos.keys() | neg.keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], ["term", "pos", "neg"])

    counts = labelled.select("text", "toxic").mapInArrow(work, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return [r[0] for r in counts.where((F.col("pos") == 0) & (F.col("neg") >= LEAST_CLEAN)).select("term").orderBy("term").collect()]


class Scorer:
    def __init__(self, weights: dict[str, float], exceptions: list[str] = (), curve: tuple[float, ...] = (-4.0, 2.0, 0.0)):
        self.weights, self.exceptions, self.curve, self.automaton = dict(weights), [f" {' '.join(folded(x).split())} " for x in exceptions], curve, None

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(first, last, weight) of each hit in a folded text that no exception holds."""
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for t, w in (self.weights | {x: None for x in self.exceptions}).items():
                self.automaton.add_word(t, (len(t), w))
            if len(self.automaton):
                self.automaton.make_automaton()
        if not len(self.automaton):
            return []
        found = [(end - n + 1, end, w) for end, (n, w) in self.automaton.iter(text)]
        spared = sorted((a, b) for a, b, w in found if w is None)
        if not spared:
            return found
        starts, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))  # the furthest end of those that begin so far
        inside = lambda a, b: (i := bisect_right(starts, a)) and reach[i - 1] >= b
        return [(a, b, w) for a, b, w in found if w is not None and not inside(a, b)]

    def beside(self, text: str) -> set[str]:
        """The words that hold hits with the word before and with the word after, in a folded text."""
        out = set()
        for a, b, _ in self.hits(text):
            end = text.find(" ", max(b, a + 1))
            word = text[a + 1 : end]
            before, after = text[max(0, a - 40) : a].split()[-1:], text[end : end + 40].split()[:1]
            if before:
                out.add(f" {before[0]} {word} ")
            if after:
                out.add(f" {word} {after[0]} ")
        return out

    def features(self, text: str) -> tuple[float, float]:
        """Both for each 100 words, and GRACE words: log1p of the summed weights, and log1p of the different terms."""
        t = folded(text)
        found = self.hits(t)
        if not found:
            return 0.0, 0.0
        hundreds = (len(t.split()) + GRACE) / 100
        return math.log1p(sum(w for *_, w in found) / hundreds), math.log1p(len({t[a : b + 1] for a, b, _ in found}) / hundreds)

    def score(self, text: str) -> float:
        a, b = self.features(text)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fitted_curve(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, ...]:
    """Logistic regression by damped Newton steps, with a weak penalty; slopes are not negative."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + 0.05 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(len(w)) + 1e-6
        w = w - 0.7 * np.linalg.solve(hess, grad)
    return (float(w[0]), *np.maximum(w[1:], 0).tolist())


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))


def learn(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = ()) -> Scorer:
    """From labelled rows outside fold 0 of 5. Without both labels among them the lexicon is empty and every score the same."""
    lab = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(fold_of(F.col("doc_id"), 5) != 0)
    n = lab.count()
    keep = lab.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(min(1.0, MAX_ROWS / max(n, 1)) * 1_000_000)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    keep = F.broadcast(written(keep, "tox-labels"))  # MAX_ROWS at most, in the mean
    rows = written(docs.select("doc_id", text_of("text").alias("text")).join(keep, "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")), "tox-train")  # copies teach nothing more
    tally = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    pos, neg = tally.get(True, 0), tally.get(False, 0)
    if not pos or not neg:
        return Scorer({}, exceptions, (-2.0, 0.0, 0.0))
    weights, spared = lexicon(written(counted(rows), "tox-terms"), pos, neg)
    made = Scorer(weights, [*spared, *exceptions])
    made = Scorer(weights, [*spared, *phrases(rows, made), *exceptions])

    def work(batches):
        for batch in batches:
            x = [made.features(t.as_py() or "") for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64()), pa.array([int(y > 0) for y in batch["toxic"].to_pylist()], pa.int32())], ["a", "b", "y"])

    # Rows with equal figures are fitted as one; there are at most MAX_ROWS.
    got = np.array([tuple(r) for r in rows.select("text", "toxic").mapInArrow(work, "a double, b double, y int").collect()], float)
    made.curve = fitted_curve(got[:, :2], got[:, 2])
    return made


def scored(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs. Null and empty texts get the score of a text without hits; very long
    texts are searched whole, in time linear in their length; equal texts and repeated rows get equal scores; a document with several labels
    is toxic if one says so; other columns are not read; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, exceptions))

    @F.arrow_udf("double")
    def score(batch: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(x.as_py() or "") for x in batch], pa.float64())

    out = docs.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), score(text_of("text")).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op8_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL: dict[str, str] = {}
QUERIES = {"op8_toxicity_lexicon": op8_toxicity_lexicon}
