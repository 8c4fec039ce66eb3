"""Line dedup keeps no short line that an earlier one repeats."""

import random

from perkolat.llm import linededup


def test_short_lines_against_brute_force(spark):
    rng = random.Random(5)
    line = lambda: " ".join(rng.choice(["ab", "Ab", "c", "dd", "e", "f", "g"]) for _ in range(rng.randrange(1, 8)))
    docs = [(i, "\n".join(line() for _ in range(rng.randrange(1, 4)))) for i in range(80)]
    got = {r["doc_id"]: list(r["removed_lines"]) for r in linededup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    seen = []
    for i, t in docs:
        gone = []
        for k, x in enumerate(t.split("\n")):
            s = set(x.lower().split())
            if any(5 * len(s & y) >= 4 * len(s | y) for y in seen):
                gone.append(k)
            seen.append(s)
        assert got[i] == gone


def test_four_words_of_five(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "d c b a"), (3, "a b c"), (4, "c\tB a"), (5, "a b"), (6, "a"), (7, "A a")], "doc_id long, text string")
    assert {r["doc_id"] for r in linededup.dedup(docs).where("n_removed = 1").collect()} == {2, 4, 7}
