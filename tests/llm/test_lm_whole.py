"""The language model learns from every training document, also from those that its start leaves out."""

import zlib

from perkolat.llm import lm


def test_order_is_learnt_from_documents_that_the_start_does_not_draw(spark, monkeypatch):
    for k, x in {"TOP": 6, "CLASSES": 3, "GROUPS": 4, "STEPS": 1, "BATCH": 64, "DOCS": 0, "WHOLE_RATE": 0.3}.items():
        monkeypatch.setattr(lm, k, x)
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = next(i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(i, "a b c d e f " * 10) for i in ids] + [(held, "a b c d e f " * 3), (held, "f e d c b a " * 3)]
    got = sorted(r["score"] for r in lm.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect() if r["held_out"])
    assert got[1] > got[0] + 5  # the same words: only their order tells the two apart


def test_documents_of_one_partition_and_of_many_count_alike(spark, monkeypatch):
    for k, x in {"TOP": 6, "CLASSES": 3, "GROUPS": 4, "STEPS": 5, "BATCH": 64}.items():
        monkeypatch.setattr(lm, k, x)
    rows = [(i, "a b c " * (1 + i % 5)) for i in range(60)] + [(90, None), (91, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = ({r["doc_id"]: r["score"] for r in lm.scored(docs.repartition(n, "doc_id")).collect()} for n in (1, 8))
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 0.2 * abs(one[k]) + 0.2 for k in one)
