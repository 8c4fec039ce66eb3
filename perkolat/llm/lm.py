"""Language-model scoring with a log-bilinear neural model, trained in numpy by noise-contrastive estimation.

The model predicts a word from the WINDOW words before it: the context is the sum of their vectors, each scaled by its position, and an
outcome's score the product of its vector with the context's, plus a bias. Outcomes are told in two steps, so that probabilities are
normalised exactly by two small batched matrix products: first one of the classes into which the TOP words are cut by equal mass, or one
of the groups of all other words by their first two bytes, or the end; then the word of the class. A word of a group has its share of
the group by add-one counts over the whole training corpus, with one share for words not seen.

Counts of all training words give the biases, the classes, the groups' shares and the base. Vectors start from minibatches on windows
that Spark draws by hash from all training documents, and then learn from every window of every training document: each task goes over
its own, and the changes are averaged.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of, written

FOLDS, HELD_OUT = 7, 2
#: Words with vectors of their own, classes of them, groups of other words, and words of context.
TOP, CLASSES, GROUPS, WINDOW = 8192, 128, 64, 4
#: Most words whose counts every worker holds; counts of the others are joined.
HEAD = 250_000
#: The start: noise words for each token, minibatches of windows, from about DOCS documents. Windows are drawn so that, in the mean, each is
#: used once; of a smaller corpus all are taken.
DIM, NOISE, STEPS, BATCH, RATE, SEED, DOCS = 32, 16, 500, 4096, 0.1, 7, 40_000
#: The pass over all windows: noise words for each token, the rate, and numbers of the model in a row of its changes.
WHOLE_NOISE, WHOLE_RATE, PIECE = 4, 0.05, 8192
#: Documents and tokens that a worker holds at once.
SLICE, CHUNK = 256, 16_384
#: Rows whose scores fit a core's cache; this changes the work alone.
BLOCK = 1024
FLUSH = 300_000


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def group_of(word: bytes, groups: int) -> int:
    return zlib.crc32(word[:2]) % groups


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over texts(text), written."""

    def work(batches):
        c: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "c"])

        for batch in batches:
            for t in batch["text"].cast(pa.binary()).to_pylist():
                c.update(tokens(t))
                if len(c) > FLUSH:
                    yield out()
                    c.clear()
        yield out()

    return written(texts.select("text").mapInArrow(work, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "lm-vocabulary")


@dataclass
class Tables:
    """What workers hold, of a size set by parameters: the head's counts, the groups' sizes, the classes and the model."""

    words: list[bytes]  # head words, those with vectors first
    counts: np.ndarray
    groups: np.ndarray  # sum of (c + 1) over a group's words, plus one for words not seen
    n: int
    v: int
    docs: int
    sizes: tuple[int, int, int]  # TOP, CLASSES, GROUPS
    model: dict[str, np.ndarray] | None = None
    at: dict[bytes, int] | None = field(default=None, init=False, repr=False)

    def index(self) -> None:
        """What follows from the fields; once, however many tasks a worker runs."""
        if self.at is not None:
            return
        self.at = {w: i for i, w in enumerate(self.words)}
        top, classes, self.n_groups = self.sizes
        self.top = min(top, len(self.words))
        # Symbols of a context: a word with a vector, a group, the start; the end is none.
        self.start, self.end = self.top + self.n_groups, self.top + self.n_groups + 1
        self.symbol = np.array([i if i < self.top else self.top + group_of(w, self.n_groups) for i, w in enumerate(self.words)] or [0], np.int32)
        mass = self.counts[: self.top].astype(float)
        cut = np.minimum((np.cumsum(mass) - mass) / max(1.0, mass.sum()) * classes, classes - 1).astype(int)
        of_class = np.unique(cut, return_inverse=True)[1].astype(np.int32) if self.top else np.empty(0, np.int32)
        self.classes = int(of_class.max()) + 1 if self.top else 0
        self.first = np.searchsorted(of_class, np.arange(self.classes + 1))  # of the words of each class
        # The first step's outcome of a symbol: class, group, start (none), end.
        self.outcome = np.concatenate([of_class, self.classes + np.arange(self.n_groups), [0, self.classes + self.n_groups]]).astype(np.int32)
        self.log_c = np.log10(np.append(self.counts, 0) + 1.0)
        self.log_z = np.log10(self.groups.astype(float))
        self.of_prefix: dict[bytes, int] = {}

    def group(self, word: bytes) -> int:
        g = self.of_prefix.get(word[:2])
        if g is None:
            g = self.of_prefix[word[:2]] = group_of(word, self.n_groups)
        return g

    def symbols(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Of the documents in a row, each as start, its words, end: symbols, places in the head (-1: not there), lengths."""
        get = self.at.get
        places, lengths = [], []
        for d in docs:
            places.append(-2)
            places.extend([get(w, -1) for w in d])
            places.append(-3)
            lengths.append(len(d) + 2)
        at = np.array(places, np.int64)
        sym = self.symbol[np.maximum(at, 0)].copy()
        sym[at == -2], sym[at == -3] = self.start, self.end
        rare = np.flatnonzero(at == -1)
        if len(rare):
            flat = [w for d in docs for w in (b"", *d, b"")]
            sym[rare] = [self.top + self.group(flat[i]) for i in rare.tolist()]
        return sym, at, lengths

    def windows(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all symbols but starts, and the WINDOW symbols before each, nearest first; before a document are starts."""
        begin = np.maximum.accumulate(np.where(sym == self.start, np.arange(len(sym)), 0))
        here = np.flatnonzero(sym != self.start)
        return here, np.stack([sym[np.maximum(here - j, begin[here])] for j in range(1, WINDOW + 1)], axis=1)

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log10 of the probability of each target symbol after its context(WINDOW symbols), normalised."""
        p, out = self.model, np.empty(len(target))
        scaled = [p["R"] * c for c in p["C"]]
        for at in range(0, len(target), CHUNK):
            ctx, t = context[at : at + CHUNK], target[at : at + CHUNK]
            h = scaled[0][ctx[:, 0]]
            for j in range(1, WINDOW):
                h += scaled[j][ctx[:, j]]
            first = self.outcome[t]
            own = np.concatenate([picked(h[i : i + BLOCK] @ p["Q"].T + p["b"], first[i : i + BLOCK]) for i in range(0, len(t), BLOCK)])
            words = np.flatnonzero(t < self.top)
            words = words[np.argsort(first[words], kind="stable")]
            ends = np.searchsorted(first[words], np.arange(self.classes + 1))
            for c in range(self.classes):
                rows, a, b = words[ends[c] : ends[c + 1]], self.first[c], self.first[c + 1]
                if len(rows) and b - a > 1:
                    own[rows] += picked(h[rows] @ p["W"][a:b].T + p["d"][a:b], t[rows] - a)
            out[at : at + CHUNK] = own
        return out / math.log(10)


def picked(scores: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log of the softmax of each row at its target. Overwrites scores."""
    scores -= scores.max(axis=1, keepdims=True)
    hit = scores[np.arange(len(target)), target]
    np.exp(scores, out=scores)
    return hit - np.log(scores.sum(axis=1))


def drawn(training: DataFrame, shared, n_docs: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows and their targets, sorted, drawn by hash from training(doc_id, text): BATCH * STEPS at most in the mean."""
    part = min(1.0, DOCS / max(n_docs, 1))
    rate = min(1.0, BATCH * STEPS / max(n * part, 1))

    def work(batches):
        t = shared.value
        t.index()
        for batch in batches:
            raw = batch["text"].cast(pa.binary())
            for at in range(0, len(raw), SLICE):
                texts = raw[at : at + SLICE].to_pylist()
                sym, _, _ = t.symbols([tokens(x) for x in texts])
                here, ctx = t.windows(sym)
                seed = zlib.crc32(b"\n".join(x or b"" for x in texts))
                keep = np.random.default_rng(seed).random(len(here)) < rate
                rows = np.column_stack([ctx[keep], sym[here[keep]]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, j]) for j in range(WINDOW + 1)], [f"c{j}" for j in range(WINDOW + 1)])

    few = training.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(1_000_000)) < int(part * 1_000_000))
    got = few.select("text").mapInArrow(work, ", ".join(f"c{j} int" for j in range(WINDOW + 1))).toArrow()
    rows = np.column_stack([got[f"c{j}"].to_numpy() for j in range(WINDOW + 1)]).astype(np.int32)
    rows = rows[np.lexsort(rows.T)]  # the same order whatever the partitions
    return rows[:, :WINDOW], rows[:, WINDOW]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def summed(rows: np.ndarray, factors: np.ndarray, vectors: np.ndarray, n: int) -> np.ndarray:
    """For each of n row numbers the sum of factors[i, j] * vectors[i] where rows[i, j] is that number; a factor may differ by the vector's
    place: factors[k][i, j]. Added up a place at a time, as the sums of one place stay in the cache."""
    out, at = np.empty((vectors.shape[1], n), np.float32), rows.ravel().astype(np.int64)
    for k, x in enumerate(vectors.T.astype(float)):
        out[k] = np.bincount(at, (x[:, None] * (factors[k] if factors.ndim == 3 else factors)).ravel(), n)
    return out.T


class Trainer:
    """The vectors and biases of a log-bilinear model under noise-contrastive estimation with Adagrad on minibatches.

    The noise of the first step is the outcomes' own distribution over the corpus, `noise` times for each token, taken in expectation;
    that of the second is `noise` words of the target's class, drawn by their counts."""

    def __init__(self, t: Tables, dim: int, noise: int, rng: np.random.Generator, p: dict | None = None, v: dict | None = None):
        f, self.t, self.noise, self.rng = np.float32, t, noise, rng
        first = np.zeros(t.classes + t.n_groups + 1)
        np.add.at(first, t.outcome[: t.top], t.counts[: t.top])
        first[t.classes : t.classes + t.n_groups] = t.groups
        first[-1] = t.docs
        first = (first + 0.5) / (first + 0.5).sum()
        word = t.counts[: t.top] + 1.0
        for c in range(t.classes):
            own = slice(t.first[c], t.first[c + 1])
            word[own] /= word[own].sum()
        self.upto = np.cumsum(word)  # over the classes in a row: class c has the numbers from c to c + 1
        if p is None:
            p = {
                "R": rng.normal(0, 0.1, (t.top + t.n_groups + 1, dim)), "C": np.linspace(1.0, 0.5, WINDOW)[:, None] * np.ones(dim), "Q": rng.normal(0, 0.1, (len(first), dim)), "b": np.log(first),
                "W": rng.normal(0, 0.1, (t.top, dim)), "d": np.log(word),
            }
        self.p = {k: x.astype(f) for k, x in p.items()}  # copies
        self.v = {k: np.full_like(x, 1.0) for k, x in self.p.items()} if v is None else {k: x.copy() for k, x in v.items()}
        self.share = noise * first.astype(f)
        self.log_first, self.log_word = np.log(noise * first).astype(f), np.log(noise * word).astype(f)

    def step(self, ctx: np.ndarray, tg: np.ndarray, lr: float) -> None:
        """One minibatch: the WINDOW symbols before each target, nearest first, and the targets."""
        t, p, f, n, dim = self.t, self.p, np.float32, len(tg), self.p["R"].shape[1]
        r = [p["R"].take(ctx[:, j], axis=0) for j in range(WINDOW)]
        h = np.empty((n, dim + 1), f)  # and one for the bias
        h[:, dim] = 1
        np.multiply(r[0], p["C"][0], out=h[:, :dim])
        for j in range(1, WINDOW):
            h[:, :dim] += r[j] * p["C"][j]
        # First step: all outcomes as noise, weighted by their share; in blocks that stay in the cache.
        one, gh, grad = t.outcome[tg], np.empty((n, dim), f), {}
        q = np.concatenate([p["Q"], (p["b"] - self.log_first)[:, None]], axis=1)
        whole, minus = np.zeros_like(q), -q.T
        for i in range(0, n, BLOCK):
            own, k = h[i : i + BLOCK], one[i : i + BLOCK]
            g, at = own @ minus, np.arange(len(k))
            np.exp(np.minimum(g, 30, out=g), out=g)
            g += 1
            hit = 1 / g[at, k]
            np.divide(self.share, g, out=g)
            g[at, k] -= 1 - hit
            np.matmul(g, p["Q"], out=gh[i : i + BLOCK])
            whole += g.T @ own
        grad["Q"], grad["b"] = whole[:, :dim], whole[:, dim]
        # Second step: words of the class.
        w = np.flatnonzero(tg < t.top)
        if len(w):
            k, hw = one[w], h[w, :dim]
            u = np.minimum(np.searchsorted(self.upto, k[:, None] + self.rng.random((len(w), self.noise))), t.first[k + 1][:, None] - 1)
            u = np.maximum(u, t.first[k][:, None])
            every = np.concatenate([tg[w][:, None], u], axis=1)
            vec = p["W"].take(every, axis=0)
            s2 = sigmoid(np.einsum("nkd,nd->nk", vec, hw) + (p["d"] - self.log_word)[every])
            s2[:, 0] -= 1
            gh[w] += np.einsum("nk,nkd->nd", s2, vec)
            s2 = s2.astype(float)
            grad["W"] = summed(every, s2, hw, t.top)
            grad["d"] = np.bincount(every.ravel(), s2.ravel(), t.top)
        grad["C"] = np.stack([np.einsum("nd,nd->d", gh, x) for x in r])
        grad["R"] = summed(ctx, p["C"].T.astype(float)[:, None, :], gh, len(p["R"]))
        for key, x in grad.items():
            x = np.ascontiguousarray(x, f)
            step = x * x
            self.v[key] += step  # by element, over all steps: rare words keep their rate
            np.sqrt(self.v[key], out=step)
            np.divide(x, step, out=step)
            step *= f(lr)
            p[key] -= step


def fitted(t: Tables, context: np.ndarray, target: np.ndarray, dim: int = DIM, noise: int = NOISE, steps: int = STEPS, rate: float = RATE, seed: int = SEED) -> Trainer:
    """A trainer after so many minibatches of the windows given, at a rate that falls to nothing over the later half."""
    rng = np.random.default_rng(seed)
    own = Trainer(t, dim, noise, rng)
    order = np.empty(0, int)
    for step in range(1, steps + 1 if len(target) else 1):
        if len(order) < min(BATCH, len(target)):
            order = rng.permutation(len(target))
        some, order = order[:BATCH], order[BATCH:]
        own.step(context[some], target[some], rate * min(1.0, 2 * (1 - step / (steps + 1))))
    return own


def learnt(training: DataFrame, shared, dim: int = DIM, seed: int = SEED) -> dict[str, np.ndarray]:
    """The model after every window of every training document: from the start that shared(tables, its model, Adagrad's sums) holds, each
    task goes over its rows once, and the tasks' changes are averaged by their windows. A document counts in full, however long; the
    result depends on how the input is cut into partitions, but not on which task ends first."""

    def work(batches):
        t, p, v = shared.value
        t.index()
        own, n = Trainer(t, dim, WHOLE_NOISE, np.random.default_rng(seed), p, v), 0
        for batch in batches:
            raw = batch["text"].cast(pa.binary())
            for at in range(0, len(raw), SLICE):
                sym, _, _ = t.symbols([tokens(x) for x in raw[at : at + SLICE].to_pylist()])
                here, ctx = t.windows(sym)
                target = sym[here]
                order = own.rng.permutation(len(here))
                for some in np.array_split(order, -(-len(order) // BATCH)):
                    own.step(ctx[some], target[some], WHOLE_RATE)
                n += len(here)
        if n:
            rows = [(k, i, n, flat[i : i + PIECE].tobytes()) for k in sorted(p) for flat in [(own.p[k] - p[k]).ravel()] for i in range(0, len(flat), PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["name", "at", "n", "change"])

    def averaged(key, pdf):
        pdf = pdf.sort_values(["n", "change"])
        total = sum((n * np.frombuffer(x, np.float32).astype(float) for n, x in zip(pdf["n"], pdf["change"])), 0.0)
        return pd.DataFrame([{"name": key[0], "at": key[1], "change": (total / pdf["n"].sum()).astype(np.float32).tobytes()}])

    made = written(training.select("text").mapInArrow(work, "name string, at long, n long, change binary"), "lm-changes")
    p = {k: x.copy() for k, x in shared.value[1].items()}
    for r in made.groupBy("name", "at").applyInPandas(averaged, "name string, at long, change binary").collect():
        x = np.frombuffer(r["change"], np.float32)
        p[r["name"]].reshape(-1)[r["at"] : r["at"] + len(x)] += x
    return p


def train(t: Tables, context: np.ndarray, target: np.ndarray, training: DataFrame | None = None, dim: int = DIM, noise: int = NOISE, steps: int = STEPS, rate: float = RATE, seed: int = SEED) -> dict[str, np.ndarray]:
    """The vectors and biases after the windows given, and then after all windows of training(text)."""
    start = fitted(t, context, target, dim, noise, steps, rate, seed)
    return start.p if training is None else learnt(training, training.sparkSession.sparkContext.broadcast((t, start.p, start.v)), dim, seed)


def tables_of(vocabulary: DataFrame, train_docs: int, head: int = HEAD) -> Tables:
    """From (word, c): the head is all words with at least the least count of which no more than `head` have as many."""
    step = F.floor(F.log2("c") * 16).cast("int")
    total = vocabulary.agg(F.sum("c"), F.count("*")).first()
    hist = sorted(((r["k"], r["n"]) for r in vocabulary.groupBy(step.alias("k")).agg(F.count("*").alias("n")).collect()), reverse=True)
    have, least = 0, None
    for k, n in hist:
        if have + n > head and have >= TOP:
            break
        have, least = have + n, k
    rows = vocabulary.where(step >= F.lit(least if least is not None else 0)).select("word", "c").toArrow() if least is not None else None
    pairs = sorted(zip(rows["word"].to_pylist(), rows["c"].to_pylist()), key=lambda x: (-x[1], x[0])) if rows is not None else []
    top = [w for w, _ in pairs[:TOP]]
    g = F.pmod(F.crc32(F.substring("word", 1, 2)), F.lit(GROUPS))
    sums = np.ones(GROUPS, np.int64)
    for r in vocabulary.groupBy(g.alias("g")).agg(F.sum(F.col("c") + 1).alias("s")).collect():
        sums[r["g"]] += r["s"]
    for w, c in pairs[:TOP]:
        sums[group_of(w, GROUPS)] -= c + 1
    ends = int(train_docs > 0)
    assert len(top) == min(TOP, len(pairs))
    return Tables([w for w, _ in pairs], np.array([c for _, c in pairs], np.int64), sums, (total[0] or 0) + train_docs, (total[1] or 0) + ends, train_docs, (TOP, CLASSES, GROUPS))


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns for every row of docs. Null and empty texts are an end alone; very long texts are scored whole, a chunk of
    tokens at a time; a null id counts as an empty text for its fold; equal texts and repeated rows get equal scores; without training
    texts every count is zero; other columns are not read; an empty table gives no rows."""
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(FOLDS))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold == HELD_OUT).alias("held_out"), text_of(text_col).alias("text"))
    training = own.where(~F.col("held_out"))
    n_docs = training.count()
    vocabulary = word_counts(training)
    t = tables_of(vocabulary, n_docs)
    windows = drawn(training, spark.sparkContext.broadcast(t), n_docs, t.n)
    t.index()
    t = replace(t, model=train(t, *windows, training))
    shared = spark.sparkContext.broadcast(t)

    def work(batches):
        t = shared.value
        t.index()
        log_end, end_known = math.log10(n_docs + 1), int(n_docs > 0)
        for batch in batches:
            raw = batch["text"].cast(pa.binary())
            for at in range(0, len(raw), SLICE):
                part = [tokens(x) for x in raw[at : at + SLICE].to_pylist()]
                sym, place, lengths = t.symbols(part)
                here, ctx = t.windows(sym)
                total = np.zeros(len(sym))
                total[here] = t.log_probabilities(ctx, sym[here])
                grouped = (sym >= t.top) & (sym < t.start)
                total[grouped] -= t.log_z[sym[grouped] - t.top]
                held = place >= 0
                log_c = np.where(held, t.log_c[np.where(held, place, len(t.words))], 0.0)
                total += np.where(grouped, log_c, 0.0)
                base = log_c + np.where(place == -3, log_end, 0.0)
                begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(int)
                known = np.add.reduceat(held, begin) + end_known if len(begin) else []
                tail = []
                for d, a, n in zip(part, begin.tolist(), lengths):
                    own_place = place[a + 1 : a + n - 1]
                    tail.append(list(Counter(d[i] for i in np.flatnonzero(own_place == -1).tolist()).items()))
                words = pa.array([[w for w, _ in x] for x in tail], pa.list_(pa.binary()))
                tfs = pa.array([[k for _, k in x] for x in tail], pa.list_(pa.int64()))
                own_rows = [batch["doc_id"][at : at + SLICE], batch["held_out"][at : at + SLICE], pa.array([n - 1 for n in lengths], pa.int64()), pa.array(known, pa.int64()), pa.array(np.add.reduceat(base, begin)), pa.array(np.add.reduceat(total, begin)), words, tfs]
                yield pa.RecordBatch.from_arrays(own_rows, ["doc_id", "held_out", "n_tokens", "known", "base", "model", "words", "tfs"])

    schema = "doc_id long, held_out boolean, n_tokens long, known long, base double, model double, words array<binary>, tfs array<long>"
    rows = written(own.mapInArrow(work, schema).withColumn("rid", F.monotonically_increasing_id()), "lm-heads")
    tail = rows.select("rid", F.explode(F.arrays_zip("words", "tfs")).alias("w")).select("rid", F.col("w.words").alias("word"), F.col("w.tfs").alias("tf"))
    # Words outside the head: each document's distinct ones meet their counts, partial sums go back.
    met = tail.join(vocabulary, "word").groupBy("rid").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("tail"), F.sum("tf").alias("tail_known"))
    all_ = rows.drop("words", "tfs").join(met, "rid", "left").na.fill(0, ["tail", "tail_known"])
    floor = math.log10(t.n + t.v + 1)
    return all_.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("tail_known")).alias("n_known"), F.lit(t.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("tail") - F.col("n_tokens") * floor).alias("base_score"), (F.col("model") + F.col("tail")).alias("score"),
    )


def op6_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op6_log_bilinear": op6_log_bilinear}
