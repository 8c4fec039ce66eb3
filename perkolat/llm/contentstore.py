"""Token ids in a content-addressed store.

A rolling hash over the last 16 ids cuts each document's id stream into chunks, so that equal passages give equal chunks
wherever they stand. A chunk is stored once under the SHA-256 of its ids; a document is a recipe, the list of its chunks, with
their Merkle root; the manifest's levels fold blocks of recipes, in document order, up to one root.

Store: chunks/ (hash, payload: zstd of little-endian ids), recipes/ (rid, doc_id, n_tokens, chunks, root; rid ascends with
doc_id), manifest/ (level, block, n, root). Everything goes through Spark's readers and writers.
"""

from __future__ import annotations

import hashlib
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, table, text_of, written

END_ID = 2
#: Ids in a chunk: least, at the mean beyond the least (a power of two), most.
LEAST, MEAN, MOST = 256, 1024, 8192
FAN_OUT = 1024
#: Known words beyond which a worker keeps only those of the texts at hand.
CACHE_WORDS = 1_200_000
#: Bytes of text whose words are told apart together.
PIECE_BYTES = 16 << 20
#: A digit is a piece, and here a token, of its own: it parts words which are encoded together.
_MARK = b"0"
_GEAR = np.random.default_rng(20_240_101).integers(0, 2**32, 1 << 17, dtype=np.uint32)


class Encoder:
    """Whole texts to ids. The tokenizer's normaliser and splitter never join what ASCII white space parts, so that a word's ids do
    not depend on its neighbours; each distinct word is encoded by the tokenizers library once and kept."""

    def __init__(self, path: str, end_id: int = END_ID, width: int = 2):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.kind = Tokenizer.from_file(path), np.dtype(f"<u{width}")
        # The known words and, for each, where its ids stand in the pool.
        self.words, self.pool = pa.array([], pa.binary()), np.array([], self.kind)
        self.first, self.size = np.array([], np.int64), np.array([], np.int64)
        self.end = np.array([end_id], self.kind)
        self.mark = self.ids(_MARK)
        self.stops = {c: self.ids(bytes([c])).tobytes() for c in b".,"}

    def ids(self, text: bytes) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, self.kind)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, the end id last. Arrow tells the words apart; Python meets those that are not known yet."""
        # Lower case first, as the normaliser does; not where that could make one of the special tokens.
        lower = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(lower)
        words = split.flatten().dictionary_encode()
        at = self.places(words.dictionary.cast(pa.binary()))[words.indices.to_numpy()]
        size = self.size[at]
        upto = np.concatenate([[0], np.cumsum(size)])
        move = (self.first[at] - upto[:-1]).astype(np.int32)
        ids = self.pool[np.arange(upto[-1], dtype=np.int32) + np.repeat(move, size)]
        ends = upto[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        return [np.concatenate([ids[a:b], self.end]) for a, b in zip(ends, ends[1:])]

    def places(self, words: pa.Array) -> np.ndarray:
        """Where each of the distinct words stands among those known; new ones are learnt."""
        at = pc.index_in(words, value_set=self.words)
        if len(self.words) > CACHE_WORDS:  # those met again stay
            keep = at.drop_null()
            own = keep.to_numpy()
            size = self.size[own]
            parts = [self.pool[a : a + n] for a, n in zip(self.first[own].tolist(), size.tolist())]
            self.words, self.size, self.first, self.pool = self.words.take(keep), size, np.cumsum(size) - size, np.concatenate([self.pool[:0], *parts])
            at = pc.index_in(words, value_set=self.words)
        if not at.null_count:
            return at.to_numpy()
        new = set(words.filter(pc.is_null(at)).to_pylist())
        # A stop or comma after an ASCII letter is a piece of its own.
        ends = {w: w[:-1] for w in new if w[-1:] in (b".", b",") and w[-2:-1].isalnum()}
        bare = list(set(ends.values()) - new)
        there = pc.index_in(pa.array(bare, pa.binary()), value_set=self.words).to_pylist()
        cores = [*(new - ends.keys()), *(w for w, k in zip(bare, there) if k is None)]
        got = {w: self.pool[self.first[k] : self.first[k] + self.size[k]].tobytes() for w, k in zip(bare, there) if k is not None}
        for k in range(0, len(cores), 64):
            self.learn(cores[k : k + 64], got)
        for w, core in ends.items():
            got[w] = got[core] + self.stops[w[-1]]
        fresh = [*new, *(w for w, k in zip(bare, there) if k is None)]
        size = np.array([len(got[w]) for w in fresh], np.int64) // self.kind.itemsize
        self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(size) - size])
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join([got[w] for w in fresh]), self.kind)])
        self.words, self.size = pa.concat_arrays([self.words, pa.array(fresh, pa.binary())]), np.concatenate([self.size, size])
        return pc.index_in(words, value_set=self.words).to_numpy()

    def learn(self, words: list[bytes], got: dict[bytes, bytes]) -> None:
        """Encode the words into got, as one text, a mark between them, and cut its ids at the mark's. A word that holds the mark goes alone."""
        plain = [w for w in words if _MARK not in w]
        ids, mark = self.ids((b" " + _MARK + b" ").join([*plain, b""])), self.mark
        at = np.flatnonzero(ids == mark[0]).tolist() if len(mark) == 1 else []
        if len(at) == len(plain):  # else some other text gave the mark's id, or the mark is not one token
            raw, k = ids.tobytes(), self.kind.itemsize
            for w, a, b in zip(plain, [-1, *at], at):
                got[w] = raw[(a + 1) * k : b * k]
        for w in words:
            if w not in got:
                got[w] = self.ids(w).tobytes()


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks: where the rolling hash of the last 16 ids has its low bits 0, but at least LEAST and at most MOST ids apart."""
    n = len(ids)
    h = _GEAR[ids.astype(np.uint32) & np.uint32((1 << 17) - 1)]
    for k in (1, 2, 4, 8):
        if n > k:
            h = h.copy()
            h[k:] = h[k:] + (h[:-k] * np.uint32((2 * 0x9E3779B1 + 1) ** k & 0xFFFFFFFF))
    marks = np.flatnonzero(h & np.uint32((MEAN - 1) << 15) == 0) + 1
    out, at = [], 0
    for m in [*marks.tolist(), n]:
        while m - at > MOST:
            at += MOST
            out.append(at)
        if m - at >= LEAST or m == n and m > at:
            out.append(m)
            at = m
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Pairs are hashed together level by level; an odd one goes up as it is."""
    while len(leaves) > 1:
        leaves = [hashlib.sha256(b"".join(leaves[i : i + 2])).digest() if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


_ENCODER: list[Encoder] = []


def worker_encoder(make_encoder) -> Encoder:
    """One for each Python worker, whose words serve all its tasks. (A function of the module: what is pickled with a task would be new each time.)"""
    if not _ENCODER:
        _ENCODER.append(make_encoder())
    return _ENCODER[0]


def pieces(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
    """The batch in slices that end with the row that fills PIECE_BYTES of text."""
    upto = np.cumsum(pc.binary_length(batch["text"]).to_numpy().astype(np.int64))
    ends = [*(np.flatnonzero(np.diff(upto // PIECE_BYTES)) + 1).tolist(), len(upto)]
    return [batch.slice(a, b - a) for a, b in zip([0, *ends], ends) if b > a]


def encoded(docs: DataFrame, make_encoder) -> DataFrame:
    """(doc_id, n_tokens, chunks, root, payloads) from docs(doc_id, text). A payload is null where its task has given it before."""

    def work(batches):
        import zstandard

        encoder = worker_encoder(make_encoder)
        z, seen = zstandard.ZstdCompressor(level=3), set()
        for batch in batches:
            for part in pieces(batch):
                out = []
                for d, ids in zip(part["doc_id"].to_pylist(), encoder.encode(part["text"])):
                    ends = cuts(ids)
                    parts = [ids[a:b].tobytes() for a, b in zip([0, *ends], ends)]
                    hashes, payloads = [hashlib.sha256(c).digest() for c in parts], []
                    for c, h in zip(parts, hashes):
                        payloads.append(None if h in seen else z.compress(c))
                        seen.add(h)
                    out.append((d, len(ids), hashes, merkle(hashes), payloads))
                if len(seen) > 200_000:
                    seen.clear()
                kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "chunks": pa.list_(pa.binary()), "root": pa.binary(), "payloads": pa.list_(pa.binary())}
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds.values())], list(kinds))

    return docs.mapInArrow(work, "doc_id long, n_tokens long, chunks array<binary>, root binary, payloads array<binary>")


def manifest_of(recipes: DataFrame) -> DataFrame:
    """(level, block, n, root): level 0 folds FAN_OUT recipes in rid order within a file, each further level FAN_OUT blocks."""
    fold = lambda keyed: keyed.groupBy("block").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("at", "root"))).alias("of")).select("block", "n", F.unhex(F.sha2(F.aggregate("of", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["root"])), 256)).alias("root"))
    out, level, now = None, 0, fold(recipes.select((F.col("rid") / F.lit(FAN_OUT)).cast("long").alias("block"), F.col("rid").alias("at"), "root"))
    while True:
        now = written(now, "manifest")
        here = now.withColumn("level", F.lit(level))
        out = here if out is None else out.unionByName(here)
        if now.limit(2).count() < 2:
            return out.select("level", "block", "n", "root")
        level += 1
        ranked = now.select((F.col("block") / F.lit(FAN_OUT)).cast("long").alias("block"), F.col("block").alias("at"), "root")
        now = fold(ranked)


def write_store(docs: DataFrame, path: str, make_encoder, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode and store every row of docs. Null and empty texts are the end id alone; rows with equal ids follow each other, null
    ids first; an empty table gives an empty store; other columns are not read."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    made = written(encoded(own, make_encoder), "encoded")
    recipes = made.select("doc_id", "n_tokens", "chunks", "root")
    ordered = recipes.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")
    ordered.select(F.monotonically_increasing_id().alias("rid"), "*").write.parquet(f"{path}/recipes")
    given = made.select(F.explode(F.arrays_zip("chunks", "payloads")).alias("c")).select(F.col("c.chunks").alias("hash"), F.col("c.payloads").alias("payload")).where("payload is not null")
    given.groupBy("hash").agg(F.first("payload").alias("payload")).write.option("compression", "none").parquet(f"{path}/chunks")
    manifest_of(docs.sparkSession.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")


def _unpack(payload: bytes, hash_: bytes, width: int) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(payload)
    if hashlib.sha256(raw).digest() != hash_:
        raise ValueError(f"chunk {hash_.hex()} does not hold its own hash")
    return np.frombuffer(raw, f"<u{width}")


def crc32_combine(a: int, b: int, length: int) -> int:
    """The CRC-32 of two byte strings in a row from theirs and the second's length: a is moved on by that many zero bytes."""
    if not length:
        return a
    times = lambda m, v: _xor_rows(m, v)
    return times(_zeros(length), a) ^ b


def _xor_rows(matrix: tuple[int, ...], v: int) -> int:
    out = 0
    for row in matrix:
        if not v:
            break
        if v & 1:
            out ^= row
        v >>= 1
    return out


_POWERS: list[tuple[int, ...]] = []
_ZEROS: dict[int, tuple[int, ...]] = {}


def _zeros(length: int) -> tuple[int, ...]:
    """The operator, as 32 rows, that appends `length` zero bytes to a CRC-32: a product of its squares."""
    if length in _ZEROS:
        return _ZEROS[length]
    product = lambda a, b: tuple(_xor_rows(a, row) for row in b)
    if not _POWERS:
        bit = (0xEDB88320, *[1 << i for i in range(31)])  # one zero bit
        for _ in range(3):
            bit = product(bit, bit)
        _POWERS.append(bit)
    out, k, n = None, 0, length
    while n:
        if len(_POWERS) <= k:
            _POWERS.append(product(_POWERS[-1], _POWERS[-1]))
        if n & 1:
            out = _POWERS[k] if out is None else product(_POWERS[k], out)
        n, k = n >> 1, k + 1
    if len(_ZEROS) > 20_000:
        _ZEROS.clear()
    _ZEROS[length] = out
    return out


def digests(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """Read the store back: doc_id, start, n_tokens, ids_crc32 and whether recipe and manifest verify, for every recipe.

    Chunk files are unpacked and checked against their hashes where they lie; only each chunk's CRC-32 and length move to the
    recipes that name it, and CRCs of parts give that of the whole."""
    recipes = spark.read.parquet(f"{path}/recipes")

    def work(batches):
        for batch in batches:
            got = [_unpack(p, h, width) for h, p in zip(batch["hash"].to_pylist(), batch["payload"].to_pylist())]
            crcs = [zlib.crc32(x.astype("<u4").tobytes()) for x in got]
            yield pa.RecordBatch.from_arrays([batch["hash"].cast(pa.binary()), pa.array([len(x) for x in got], pa.int64()), pa.array(crcs, pa.int64())], ["hash", "n", "crc"])

    held = spark.read.parquet(f"{path}/chunks").select("hash", "payload").mapInArrow(work, "hash binary, n long, crc long")
    # Equal documents have equal recipes: each is put together once.
    distinct = recipes.groupBy("root").agg(F.first("chunks").alias("chunks"))
    parts = distinct.select("root", F.posexplode("chunks").alias("at", "hash")).join(held, "hash")
    whole = parts.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("at", "n", "crc", "hash"))).alias("of"))

    def join(batches):
        for batch in batches:
            out = []
            for root, of in zip(batch["root"].to_pylist(), batch["of"].to_pylist()):
                crc, n = 0, 0
                for x in of:
                    crc, n = crc32_combine(crc, x["crc"], 4 * x["n"]), n + x["n"]
                out.append((root, n, crc, merkle([x["hash"] for x in of]) == root))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.bool_()))], ["root", "n", "crc", "sound"])

    whole = whole.mapInArrow(join, "root binary, n long, crc long, sound boolean")
    manifest = spark.read.parquet(f"{path}/manifest")
    again = manifest_of(recipes)
    differ = manifest.exceptAll(again).unionByName(again.exceptAll(manifest)).limit(1).count()
    part = F.shiftright("rid", 33)
    sums = recipes.groupBy(part.alias("part")).agg(F.sum("n_tokens").alias("s"))  # one row for each file
    first = sums.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("first"))
    rows = recipes.select("rid", "doc_id", "n_tokens", "root", part.alias("part"))
    rows = rows.withColumn("pre", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("rid")) - F.col("n_tokens"))
    rows = rows.join(F.broadcast(first), "part").join(whole, "root", "left")
    sound = F.coalesce(F.col("sound") & (F.col("n") == F.col("n_tokens")), F.lit(False)) & F.lit(differ == 0)
    return rows.select("doc_id", (F.col("first") + F.col("pre")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32"), sound.alias("verified"))


def read_ids(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(rid, doc_id, ids): every document's ids, put together from the chunks."""

    def work(batches):
        for batch in batches:
            got = [_unpack(p, h, width).astype(np.int32) for h, p in zip(batch["hash"].to_pylist(), batch["payload"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["hash"].cast(pa.binary()), pa.array(got, pa.list_(pa.int32()))], ["hash", "ids"])

    held = spark.read.parquet(f"{path}/chunks").select("hash", "payload").mapInArrow(work, "hash binary, ids array<int>")
    parts = spark.read.parquet(f"{path}/recipes").select("rid", "doc_id", F.posexplode("chunks").alias("at", "hash")).join(held, "hash")
    return parts.groupBy("rid", "doc_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids"))


def op4_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    path = fresh_path(spark, "store")
    write_store(table(spark, sf_dir, "documents"), path, lambda: Encoder(vocabulary))
    return digests(spark, path)


SQL: dict[str, str] = {}
QUERIES = {"op4_content_store": op4_content_store}
