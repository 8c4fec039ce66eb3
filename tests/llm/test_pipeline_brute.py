"""The pipeline's run() against a brute-force version, and its stages on odd rows and empty tables."""

import hashlib
import random
import re
from collections import Counter

import pytest

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, doc string"


def corpus(seed):
    """Clean texts, near copies on both sides of 0.8, junk, passages of the benchmark with edits, several sources."""
    rng = random.Random(seed)
    vocab = [rng.choice("bcdfgklm") + rng.choice("aeiou") + rng.choice("nrst") + str(i % 7) * (i % 3 == 0) + rng.choice(["", "en", "or"]) for i in range(900)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [text(rng.randrange(12, 30)) for _ in range(6)]
    rows = []
    for _ in range(40):
        base = text(rng.randrange(25, 120))
        for _ in range(rng.choice([1, 1, 2, 3])):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(w)
    for k, item in enumerate(items):  # with 0 to 5 edits
        w = list(item)
        for _ in range(k):
            w[rng.randrange(len(w))] = "other"
        rows.append(text(20) + w + text(20))
    rows += [["w%%%"] * 30, text(5), ["same", "words"] * 40, text(30) * 3]
    rng.shuffle(rows)
    docs = [(i, " ".join(w) + ("\n" if i % 5 == 0 else ""), "en", rng.choice(["a", "b", "c", "d", None]), 0, "r", "d") for i, w in enumerate(rows)]
    return docs, [(i, " ".join(w)) for i, w in enumerate(items)]


def passes(text):
    ws = WORD.findall(text)
    n, chars = len(ws), max(1, sum(map(len, ws)))
    if n < 20 or len(re.findall(r"[#*$%&|<>]", text)) * 10 > 2 * n or not 2 * n <= chars <= 15 * n or sum(c.isalnum() for c in text) * 2 < chars:
        return False
    if sum(len(set(ws[i : i + 200])) for i in range(0, n, 200)) * 100 < 30 * n:
        return False
    lines = [x for x in text.split("\n") if WORD.search(x)]
    if (len(lines) - len(set(lines))) * 2 > len(text.split("\n")):
        return False
    windows = Counter(tuple(ws[i : i + 8]) for i in range(n - 7))
    repeated = {j for i in range(n - 7) if windows[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(repeated) * 100 <= 30 * n


def first_of_group(rows):
    def shingles(r):
        w = r[1].lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, group = [shingles(r) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return [min((r for r, g in zip(rows, group) if g == k), key=lambda r: r[0]) for k in sorted(set(group))]


def distance(item, text):
    """Least edit distance of the item to any run of the text's words."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def mixed(rows):
    size = {r[0]: len(WORD.findall(r[1])) for r in rows}
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None] * any(r[3] is None for r in rows)
    own = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, free, target = 1.5 * sum(own.values()), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 2 * own[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * own[s] for s in over}
        left -= sum(2 * own[s] for s in over)
        free -= over
    out = []
    for s in names:
        whole = int(target[s] // own[s])
        rest = round(target[s]) - whole * own[s]
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: hashlib.md5(f"mix-1:{r[0]}".encode()).hexdigest()):
            extra = max(0, min(size[r[0]], rest))
            rest -= extra
            out += [r[0]] * int((whole * size[r[0]] + extra) / size[r[0]] + 0.5)
    return Counter(out)


@pytest.mark.parametrize("seed", [1])
def test_run_against_brute_force(spark, tmp_path, seed):
    docs, items = corpus(seed)
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    kept = [r for r in docs if passes(r[1])]
    kept = first_of_group(kept)
    clean = [r for r in kept if not any(distance(item.split(), re.findall(r"[^\W_]+", r[1].lower())) <= int(0.2 * len(item.split())) for _, item in items)]
    assert len(docs) > len(kept) > len(clean)
    assert Counter(got["doc_id"].tolist()) == mixed(clean)
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    sizes = got.groupby("shard")["size"].sum()
    assert set(got["shard"]) <= set(range(16)) and sizes.max() <= got["size"].sum() / 16 + 2 * got["size"].max()


ODD = [(1, None, None, None, None, None, None), (None, "a b c", None, "t", 2, "y", "g"), (3, "", "de", "s", 3, "z", "h"), (4, " \t\n ", "de", None, 4, "u", "i"), (5, " ".join(f"w{i % 977}" for i in range(20_000)), "fr", "t", 5, "v", "j")] * 2


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_stages_on_odd_rows(spark, tmp_path, rows):
    spark.createDataFrame([(1, "some item of the benchmark that is nowhere"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        n = out.count()
        assert n <= 2 * len(rows)
        if k == 1:
            assert n == len({r[1] or "" if (r[1] or "").strip() else "" for r in rows})  # the texts that differ as sets
        if k in (2, 4):
            assert n == len(rows)
