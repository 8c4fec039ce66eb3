"""Each operator on small inputs: brute force, nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from perkolat.llm import contentstore, decontaminate, htmltext, linededup, lm, mixing, quality, sharding, simhash, toxicity

ODD = "doc_id long, text string, lang string, source string, size int, rid string, fp string, removed string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd(spark, rows=None):
    """Nulls in every column, empty, blank and very long texts, repeated rows, columns that operators use themselves."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    if rows is None:
        rows = [(1, "a b c", "en", "s", 1, "x", "f", "r"), (1, "a b c", "en", "s", 1, "x", "f", "r"), (2, None, None, None, None, None, None, None), (None, "a b c", None, "t", 2, "y", "g", "q"), (3, "", "de", "s", 3, "z", "h", "p"), (4, " \t\n ", "de", None, 4, "u", "i", "o"), (5, long, "fr", "t", 5, "v", "j", "n")]
    return spark.createDataFrame(rows, ODD)


def prose(n, seed, vocab=400):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(vocab)}" for _ in range(n))


def repeats(words):
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return len({j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)})


def test_quality_figures_against_brute_force(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))) for _ in range(60)] + ["x y\nx y\n\n z", "", None, prose(500, 1) + " " + prose(500, 1)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", quality.words(quality.text_of("text")).alias("ws"))
    got = df.select("text", quality.covered(quality.window_hashes(F.col("ws"))).alias("r"), quality.n_dup_lines(quality.text_of("text")).alias("d")).collect()
    for r in got:
        t = r["text"] or ""
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["r"], r["d"]) == (repeats(WORD.findall(t)), len(lines) - len(set(lines)))


def test_quality_keeps_clean_and_columns(spark):
    clean, junk = prose(200, 2), " ".join(w + "%%%" for w in prose(200, 3).split())
    docs = odd(spark, [(1, clean, "en", "s", 1, "x", "f", "r"), (2, junk, "en", "s", 1, "x", "f", "r"), (3, None, None, None, None, None, None, None)])
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [1]
    assert quality.keep(odd(spark, [])).count() == 0 and quality.keep(odd(spark)).count() >= 0


def test_mixing_meets_targets(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng.randrange(0, 90), i), "en", rng.choice(["a", "b", "c", "d", None]), 0, "", "", "") for i in range(300)]
    out = mixing.taken(mixing.sized(odd(spark, rows))).toPandas()
    for _, g in out.groupby("source_size"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 1 and (g["taken"] <= 2 * g["size"]).all()
    total, weights, caps = out["size"].sum(), {}, {}
    for k, s in enumerate(["a", "b", "c", "d", None]):
        size = out[out["source"].isna() if s is None else out["source"] == s]["size"].sum()
        weights[s], caps[s] = (5, 2, 1)[k % 3], 2 * size
    left, free, want = 1.5 * total, set(weights), {}
    while True:  # clamp and share anew
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > caps[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = caps[s]
            left -= caps[s]
        free -= over
    for s, t in want.items():
        assert math.isclose(out[out["source"].isna() if s is None else out["source"] == s]["target"].iloc[0], t, rel_tol=1e-9)


def test_mixing_odd_rows_and_rerun(spark):
    a, b = (mixing.taken(mixing.sized(odd(spark))).select("doc_id", "source", "taken").toPandas().sort_values(["doc_id", "source", "taken"]).reset_index(drop=True) for _ in range(2))
    assert len(a) == 7 and a.equals(b) and mixing.taken(mixing.sized(odd(spark, []))).count() == 0
    assert mixing.mix(odd(spark)).columns == odd(spark).columns


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(6)
    base = [prose(rng.randrange(4, 30), i) for i in range(12)]

    def edit(line):
        w = line.split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(9999)}"
        return " ".join(w)

    texts = ["\n".join(edit(rng.choice(base)) for _ in range(rng.randrange(1, 6))) for _ in range(50)]
    got = {r["doc_id"]: list(r["removed_lines"]) for r in linededup.dedup(odd(spark, [(i, t, "", "", 0, "", "", "") for i, t in enumerate(texts)])).collect()}
    seen = []
    for i, t in enumerate(texts):
        gone = []
        for k, line in enumerate(t.split("\n")):
            s = set(line.split())
            if any(5 * len(s & x) >= 4 * len(s | x) for x in seen):
                gone.append(k)
            seen.append(s)
        assert got[i] == gone


def test_line_dedup_odd_rows(spark):
    docs = odd(spark)
    assert linededup.dedup(docs).count() == 7 and linededup.dedup(odd(spark, [])).count() == 0
    out = linededup.cleaned(docs)
    assert out.columns == docs.columns and out.count() == 7


def test_encoder_forgets_and_learns_again(monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, encoder = Tokenizer.from_file(path), contentstore.Encoder(path)
    monkeypatch.setattr(contentstore, "CACHE_WORDS", 50)
    monkeypatch.setattr(contentstore, "PIECE_BYTES", 300)
    texts = ["", " a  B, a.b. ", "\x1cx\x85y z", *(prose(40, i) + f". {'Éa, É'[i % 5 :]}." for i in range(30)), *(prose(40, i) for i in range(30))]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    parts = contentstore.pieces(batch)
    assert len(parts) > 10 and sum(len(p) for p in parts) == len(texts)
    got = [ids.tolist() for p in parts for ids in encoder.encode(p["text"])]
    assert got == [[*tok.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert encoder.encode(pa.array([], pa.string())) == []


def test_content_store_round_trip(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, at = Tokenizer.from_file(path), f"{tmp_path}/store"
    docs = odd(spark).unionByName(odd(spark, [(9, "It's <|endoftext|> 100% ... é́ K x. y, (z). 2.0", "", "", 0, "", "", "")]))
    contentstore.write_store(docs, at, lambda: contentstore.Encoder(path))
    got = sorted(((r["doc_id"] or 0, r["start"], r["n_tokens"], r["ids_crc32"], r["verified"]) for r in contentstore.digests(spark, at).collect()), key=lambda r: r[1])
    start, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want.append((r["doc_id"] or 0, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True))
        start += len(ids)
    assert got == want
    whole = {r["doc_id"]: r["ids"] for r in contentstore.read_ids(spark, at).collect()}
    assert whole[5] == tok.encode(docs.where("doc_id = 5").first()["text"], add_special_tokens=False).ids + [2]
    chunks = spark.read.parquet(f"{at}/chunks")
    assert chunks.count() == chunks.select("hash").distinct().count()


def test_content_store_shares_passages():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 40_000, 20_000).astype("<u2"), rng.integers(0, 40_000, 500).astype("<u2")
    chunks = lambda x: {x[i:j].tobytes() for i, j in zip([0, *contentstore.cuts(x)], contentstore.cuts(x))}
    one, two = chunks(a), chunks(np.concatenate([b, a]))
    assert len(one & two) > 0.7 * len(one) and b"".join(x.tobytes() for x in np.split(a, contentstore.cuts(a)[:-1])) == a.tobytes()
    assert contentstore.crc32_combine(zlib.crc32(b"ab"), zlib.crc32(b"cde" * 99), 297) == zlib.crc32(b"ab" + b"cde" * 99)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><script>var t="</p>";</script><article><h1>The  title</h1><p>One &amp; two<br>three<p>Second <b>para</b></p>
<aside>Side</aside><form><input>Mail</form><div class="ad">Buy</div><section id="comments"><article class="comment"><p>First!</p></article></section></article><footer>&copy; x</footer></body></html>"""


def test_html_main_text():
    assert htmltext.main_text(PAGE) == "The title\nOne & two three\nSecond para"
    assert htmltext.main_text("") == "" and htmltext.main_text("<p") == "" and htmltext.main_text("<script>x") == ""


def test_html_without_an_article():
    good = "The house of the man is in the town and it was built by the sea for all of them to see. " * 4
    page = f"<ul><li><a href=x>Home</a></li></ul><p>{good}</p><p>Short one</p><p>{good}</p><div>All rights reserved</div>"
    text = htmltext.main_text(page)
    assert text.count("\n") == 2 and "Short one" in text and "Home" not in text and "rights" not in text


def test_html_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (1, "u", "", "x"), (None, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = htmltext.extract(pages).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 37] and htmltext.extract(pages.where("false")).count() == 0


def test_lm_base_score_and_odd_rows(spark):
    rows = [(i, prose(40, i, 30), "", "", 0, "", "", "") for i in range(60)]
    docs = odd(spark).unionByName(odd(spark, rows))
    got = lm.scored(docs).toPandas()
    data = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    train = [t for d, t in data if zlib.crc32(str("" if d is None else d).encode()) % 7 != 2]
    c = Counter(w for t in train for w in t.lower().split())
    n, v = sum(c.values()) + len(train), len(c) + 1
    want = sorted(sum(math.log10((x + 1) / (n + v + 1)) for x in [len(train), *[c[w] for w in t.lower().split()]]) for _, t in data)
    assert np.allclose(sorted(got["base_score"]), want) and (got["train_tokens"] == n).all() and np.isfinite(got["score"]).all()
    assert lm.scored(odd(spark, [])).count() == 0


def test_toxicity_learns_and_spares(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        w, bad = prose(40, i).split(), i % 4 == 0
        if bad:
            w[rng.randrange(40)] = rng.choice(["zorgling", "zorgle", "blattard"])
        rows.append((i, " ".join(w), "", "", 0, "", "", ""))
        labels.append((i, 1, int(bad)))
    docs, lab = odd(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    made = toxicity.learn(docs, lab)
    assert made.score("you z0rgling!") > 0.5 and made.score("a Blаttard") > 0.5 and made.score("a fine day") < 0.5 and made.score("") < 0.5
    spared = toxicity.Scorer(made.weights, ["zorgle house"], made.curve)
    assert spared.score("the zorgle house") < 0.5 < spared.score("the zorgle home")
    got = toxicity.scored(docs.unionByName(odd(spark)), lab).toPandas()
    assert len(got) == 407 and got["score"].between(0, 1).all() and got["held_out"].notna().all()
    assert toxicity.scored(docs.where("false"), lab.where("false")).count() == 0


def brute_components(fps, distance):
    lab = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
    while True:
        new = np.array([lab[r].min() for r in near])
        if (new == lab).all():
            return lab
        lab = new


@pytest.mark.parametrize("distance, block", [(2, 4096), (2, 6), (5, 10)])
def test_simhash_links_against_brute_force(spark, distance, block):
    rng = np.random.default_rng(distance)
    seeds = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = np.unique(np.array([s ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False))) for s in seeds for _ in range(25)], np.uint64))
    rows = simhash.written(spark.createDataFrame([(int(np.int64(f.view(np.int64))), i) for i, f in enumerate(fps)], "fp long, rep long"), "t")
    got = {r["node"]: r["component"] for r in simhash.components(simhash.links(rows, distance, block)).collect()}
    want = brute_components(fps, distance)
    assert [got.get(i, i) for i in range(len(fps))] == want.tolist()


def test_simhash_thresholds_cover_every_pair():
    groups = simhash.grouped_bits(np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.uint64), 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    t = simhash.allocate(np.random.default_rng(2).random((200, 4, 8)) * 9, 6)
    assert (t.sum(axis=1) == 6 - 4 + 1).all() and t.min() >= -1


def test_simhash_odd_rows(spark):
    docs = odd(spark)
    got = simhash.near_duplicates(docs).toPandas()
    assert len(got) == 7 and got[got["doc_id"].isin([2, 3, 4])]["component_id"].eq(2).all() and got[got["doc_id"] == 1]["component_id"].eq(1).all()
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5]
    assert simhash.near_duplicates(odd(spark, [])).count() == 0


def test_myers_against_the_table():
    rng = random.Random(9)
    for _ in range(500):
        p, t = ([rng.choice("abcd") for _ in range(rng.randint(a, 60))] for a in (1, 0))
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p):
            new = [i + 1]
            for j, y in enumerate(t):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        peq = {}
        for i, x in enumerate(p):
            peq[x] = peq.get(x, 0) | 1 << i
        assert decontaminate.myers(peq, len(p), t)[0] == min(row)


def test_decontamination(spark):
    item = prose(40, 11)
    w = item.split()
    w[5], w[20] = "changed", "twice"
    del w[30]
    texts = [prose(80, 1) + " " + item.upper() + ". " + prose(50, 2), prose(30, 3) + ", " + " ".join(w), prose(200, 4), None, "", item[:100]]
    docs = odd(spark, [(i, t, "", "", 0, "", "", "") for i, t in enumerate(texts)])
    bench = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "too short"), (10, prose(30, 99))], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.matches(docs, bench, block_chars=100).collect())
    assert got == [(0, 7, 0), (1, 7, 3)]
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [2, 3, 4, 5]
    assert decontaminate.matches(docs, bench.where("false")).count() == 0 and decontaminate.clean(odd(spark), bench).count() == 7


def test_sharding_is_even_and_gapless(spark):
    rng = random.Random(12)
    rows = [(i, "same text" if i % 3 == 0 else prose(rng.randrange(1, 60), i), "en", "s", 0, "", "", "") for i in range(900)]
    out = sharding.shard(odd(spark, rows), 16).toPandas()
    by = out.groupby("shard")
    assert len(out) == 900 and len(by) == 16 and all(sorted(g["slot"]) == list(range(len(g))) for _, g in by)
    sizes = by["size"].sum()
    assert sizes.max() - sizes.min() <= 4 * out["size"].max()


def test_sharding_odd_rows(spark):
    out = sharding.shard(odd(spark), 4).toPandas()
    assert len(out) == 7 and out[out["doc_id"] == 2]["size"].eq(1).all() and sharding.shard(odd(spark, []), 4).count() == 0
    assert sharding.shard(odd(spark), target_bytes=100_000).select("shard").distinct().count() <= 3
