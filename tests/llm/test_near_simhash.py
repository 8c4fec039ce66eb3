"""The pipeline's near-dedup goes through SimHash links, which an exact check confirms and completes."""

import random

from perkolat.llm import neardup, simhash

DOC = "doc_id long, text string, lang string"


def test_links_of_fingerprints_come_first_and_are_checked(spark, monkeypatch):
    rng = random.Random(2)
    base = [[f"w{rng.randrange(4000)}" for _ in range(600)] for _ in range(4)]
    near = [[*w[:-1], "other"] for w in base]
    rows = [(i, " ".join(w), "en") for i, w in enumerate(base + near)]
    tried, real = [], neardup.verified

    def kept(pairs, own, shingle):
        out = real(pairs, own, shingle)
        tried.append((pairs.count(), out.count()))
        return out

    monkeypatch.setattr(neardup, "verified", kept)
    assert sorted(r["doc_id"] for r in simhash.keep_first(spark.createDataFrame(rows, DOC)).collect()) == [0, 1, 2, 3]
    assert tried[0] == (4, 4) and not any(n for _, n in tried[1:])  # SimHash found all four; the rest of the join has nothing to add


def test_equal_fingerprints_of_other_texts_are_not_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(simhash, "fingerprint", lambda words, shingle, seed=0: 5)
    pairs = simhash.alike(spark.createDataFrame([(3, "a b c d e f"), (1, "g h i j k l"), (2, "m n o p q r")], "cid long, text string"), 5)
    assert {tuple(r) for r in pairs.collect()} <= {(1, 2), (1, 3)}
    rows = [(1, "a b c d e f g", "en"), (2, "h i j k l m n", "en")]
    assert simhash.keep_first(spark.createDataFrame(rows, DOC)).count() == 2


def test_long_unlike_texts_with_a_common_passage_are_told_apart_before_the_join(spark, monkeypatch):
    rng = random.Random(4)
    passage = [f"p{rng.randrange(4000)}" for _ in range(300)]
    rows = [(i, " ".join(passage + [f"w{rng.randrange(9000)}" for _ in range(1100)])) for i in range(12)]
    met, real = [], neardup.counted

    def rows_of(pairs):
        met.append(pairs.count())
        return real(pairs)

    monkeypatch.setattr(neardup, "counted", rows_of)
    neardup.linked(neardup.written(spark.createDataFrame(rows, "cid long, text string"), "t"), 5)
    assert len(met) == neardup.LEADERS + 1 and met[0] > 0 and met[-1] == 0
