"""The language model: probabilities sum to one, training learns word order, scores equal a slow reckoning word by word."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from perkolat.llm import lm


def table(words, counts, docs):
    groups = np.ones(lm.GROUPS, np.int64)
    for w, c in list(zip(words, counts))[lm.TOP :]:
        groups[lm.group_of(w, lm.GROUPS)] += c + 1
    t = lm.Tables(words, np.array(counts, np.int64), groups, sum(counts) + docs, len(words) + 1, docs, (lm.TOP, lm.CLASSES, lm.GROUPS))
    t.index()
    return t


def small(monkeypatch):
    for k, x in {"TOP": 6, "CLASSES": 3, "GROUPS": 4, "STEPS": 60, "BATCH": 512}.items():
        monkeypatch.setattr(lm, k, x)


def test_probabilities_sum_to_one_and_order_is_learnt(monkeypatch):
    small(monkeypatch)
    t = table([b"a", b"b", b"c", b"d", b"e", b"f", b"gg", b"hh"], [50, 40, 30, 20, 10, 5, 3, 2], 10)
    sym, _, _ = t.symbols([[b"a", b"b", b"c"] * 60, [b"d", b"e", b"f"] * 60])
    here, ctx = t.windows(sym)
    t.model = lm.train(t, np.tile(ctx, (20, 1)), np.tile(sym[here], 20), steps=200, rate=0.3)
    every = [x for x in range(t.end + 1) if x != t.start]
    for c in ([t.start] * 4, [0, 2, 1, 0], [3, t.top + 1, 5, t.start]):
        p = 10.0 ** t.log_probabilities(np.array([c] * len(every)), np.array(every))
        assert abs(p.sum() - 1) < 1e-4
    after_a = 10.0 ** t.log_probabilities(np.array([[0, 2, 1, 0]] * 2), np.array([1, 4]))
    assert after_a[0] > 0.5 > after_a[1]


def test_scores_against_a_slow_reckoning(spark, monkeypatch):
    small(monkeypatch)
    rng = random.Random(3)
    words = [f"{c}{i}" for c in "abcd" for i in range(5)]
    rows = [(i, " ".join(rng.choice(words[: rng.randrange(1, 20)]) for _ in range(rng.randrange(0, 30)))) for i in range(60)]
    kept = {}
    train = lm.train

    def keep(t, *args):
        kept["t"], kept["p"] = t, train(t, *args)
        return kept["p"]

    monkeypatch.setattr(lm, "train", keep)
    got = {r["doc_id"]: r["score"] for r in lm.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    t, p = kept["t"], {k: x.astype(float) for k, x in kept["p"].items()}
    counts = Counter(w.encode() for d, x in rows if zlib.crc32(str(d).encode()) % 7 != 2 for w in x.split())
    top = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: lm.TOP]]
    share = lambda w: (counts[w] + 1) / (1 + sum(c + 1 for x, c in counts.items() if x not in top and lm.group_of(x, lm.GROUPS) == lm.group_of(w, lm.GROUPS)))
    symbol = lambda w: top.index(w) if w in top else len(top) + lm.group_of(w, lm.GROUPS)
    softmax = lambda s: np.exp(s - s.max()) / np.exp(s - s.max()).sum()
    for d, x in rows:
        ws, total = [w.encode() for w in x.split()], 0.0
        for i in range(len(ws) + 1):
            ctx = [symbol(ws[i - j]) if i - j >= 0 else len(top) + lm.GROUPS for j in range(1, lm.WINDOW + 1)]
            h = sum(p["R"][c] * p["C"][j] for j, c in enumerate(ctx))
            one = softmax(p["Q"] @ h + p["b"])
            if i == len(ws):
                total += math.log10(one[-1])
            elif ws[i] in top:
                k = symbol(ws[i])
                c = int(t.outcome[k])
                of = slice(t.first[c], t.first[c + 1])
                total += math.log10(one[c]) + math.log10(softmax(p["W"][of] @ h + p["d"][of])[k - t.first[c]])
            else:
                total += math.log10(one[t.classes + lm.group_of(ws[i], lm.GROUPS)] * share(ws[i]))
        assert abs(got[d] - total) < 1e-3
