"""A step of the language model's training against a slow reckoning of the same step; a worker indexes its tables once."""

import math

import numpy as np

from perkolat.llm import lm


def tables():
    words, counts = [bytes([97 + i]) for i in range(12)], np.arange(12, 0, -1) * 10
    groups = np.ones(4, np.int64)
    for w, c in zip(words[8:], counts[8:]):
        groups[lm.group_of(w, 4)] += c + 1
    t = lm.Tables(words, counts, groups, int(counts.sum()) + 5, 13, 5, (8, 3, 4))
    t.index()
    return t


def test_tables_are_indexed_once():
    t = tables()
    before = t.at
    t.index()
    assert t.at is before


def test_a_step_equals_a_slow_one(monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 5)
    t = tables()
    own = lm.Trainer(t, 3, 2, np.random.default_rng(3))
    p = {k: x.astype(float) for k, x in own.p.items()}
    docs = [[b"a", b"b", b"l", b"c"], [], [b"h", b"z", b"a", b"a", b"g"]]
    sym, _, _ = t.symbols(docs)
    here, ctx = t.windows(sym)
    tg = sym[here]
    rng = np.random.default_rng(3)
    for key in ("R", "Q", "W"):
        rng.normal(0, 0.1, own.p[key].shape)  # the trainer's own draws
    grad = {k: np.zeros_like(x) for k, x in p.items()}
    draws = iter(rng.random((int((tg < t.top).sum()), 2)))
    sig = lambda x: 1 / (1 + math.exp(-x))
    for c, y in zip(ctx.tolist(), tg.tolist()):
        h = sum(p["R"][x] * p["C"][j] for j, x in enumerate(c))
        gh, one = np.zeros(3), t.outcome[y]
        for o in range(len(p["Q"])):
            s = sig(h @ p["Q"][o] + p["b"][o] - own.log_first[o])
            g = s * own.share[o] if o != one else s * own.share[o] - (1 - s)
            gh, grad["b"][o] = gh + g * p["Q"][o], grad["b"][o] + g
            grad["Q"][o] += g * h
        if y < t.top:
            noise = [min(max(int(np.searchsorted(own.upto, one + u)), t.first[one]), t.first[one + 1] - 1) for u in next(draws)]
            for i, o in enumerate([y, *noise]):
                g = sig(h @ p["W"][o] + p["d"][o] - own.log_word[o]) - (i == 0)
                gh, grad["d"][o] = gh + g * p["W"][o], grad["d"][o] + g
                grad["W"][o] += g * h
        for j, x in enumerate(c):
            grad["C"][j] += gh * p["R"][x]
            grad["R"][x] += gh * p["C"][j]
    own.step(ctx, tg, 0.1)
    for k, x in p.items():
        assert np.allclose(own.p[k], x - 0.1 * grad[k] / np.sqrt(1 + grad[k] ** 2), atol=1e-5), k
