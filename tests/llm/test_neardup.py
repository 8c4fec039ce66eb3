"""The pipeline's near-dedup against brute force over shingle sets."""

import random

import pytest

from perkolat.llm import neardup, simhash

DOC = "doc_id long, text string, lang string"


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    sets, group = [shingle_set(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sorted(min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group))


def corpus(seed):
    """Originals, copies with one to six words changed (similarities on both sides of 0.8), passages in common, one large group of near copies."""
    rng = random.Random(seed)
    word = lambda: f"{rng.choice('bcdfgh')}{rng.randrange(500)}"
    passage, rows = [word() for _ in range(30)], []
    for _ in range(40):
        base = [word() for _ in range(rng.randrange(3, 160))]
        for _ in range(rng.randrange(1, 5)):
            w = list(base)
            for _ in range(rng.randrange(0, 7)):
                w[rng.randrange(len(w))] = word()
            rows.append(w + passage * rng.randrange(0, 2))
    base = [word() for _ in range(120)]
    rows += [[word() if i in (k % 120, (7 * k) % 120) else x for i, x in enumerate(base)] for k in range(60)]
    rng.shuffle(rows)
    return [(i, " ".join(w), "en") for i, w in enumerate(rows)]


@pytest.mark.parametrize("hot", [2, 32])
def test_near_dedup_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(neardup, "HOT", hot)
    rows = corpus(3)
    assert sorted(r["doc_id"] for r in simhash.keep_first(spark.createDataFrame(rows, DOC)).collect()) == brute_kept(rows)


def test_null_and_repeated_ids_are_rows_of_their_own(spark):
    a, b, c = ("a b c d e f g h i j", "k l m n o p q r s t", "u v w x y z aa bb cc dd")
    rows = [(None, a, "null alone"), (None, b, "null twice"), (None, b, "null twice"), (7, a + " k", "with null"), (8, c, "same id"), (8, "other words than those of the row before", "same id, other text")]
    kept = sorted(r["lang"] for r in simhash.keep_first(spark.createDataFrame(rows + [(None, "one of its own kind", "null, like none")], DOC)).collect())
    assert kept == ["null twice", "null, like none", "same id", "same id, other text", "with null"]
