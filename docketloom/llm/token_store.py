"""Token-ID output as a content-addressed store.

Layout under one folder, all Parquet: ``raw/kind=chunk`` (key: digest, payload: ids as
little-endian unsigned integers of 16 or 32 bits, each distinct chunk once),
``recipes`` (one row per document in ascending doc_id order: segment, n_tokens,
the digests and ends of its chunks, its Merkle root) and ``manifest`` (a Merkle tree:
one root for each block of 1024 recipes over the roots and lengths of its recipes, one for each segment over its
blocks' roots, one for the store over its segments').

Reading verifies all of it: the tree is built anew from the recipes and must equal the manifest in every node, a recipe's
root must be that of its digests, a chunk must match its digest, and a document's chunks must be there and
have its recorded length together. A missing or altered chunk, recipe or node raises.

Chunk ends come from a rolling (gear) hash over the last 32 ids, so equal runs of
ids in different documents give equal chunks. Payloads pass through one shuffle,
keyed by digest with map-side combining, so a chunk that millions of documents
share travels once per task.

Edge cases: null and empty texts hold the end id alone; a null doc_id sorts first;
repeated doc_ids give one recipe each, ordered by Merkle root; an empty table gives
an empty store.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Recent, of_process, shared_dir, small, stage, write

MIN_IDS, MASK_BITS, MAX_IDS = 128, 9, 2048
BLOCK = 1024
SLICE, CACHE_WORDS = 8 << 20, 700_000
# Words of ASCII (but "<", which begins special tokens) and Latin-1 letters, and the tokenizer's split pattern for them in lower case.
PLAIN = re.compile("[!-;=-~À-ÖØ-öø-ÿ]+")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
GEAR = np.random.default_rng(20240601).integers(0, 2**32, 1 << 16, dtype=np.uint64).astype(np.uint32)


# How a tokenizer whose ids encode() can gather by words treats its text.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordEncoder:
    """Ids of texts by the tokenizers library, which sees each distinct word once.

    The tokenizer drops white space and never merges across it, so the ids of a text
    are those of its words. Only ASCII white space is split on here; the library deals
    with any other. Splitting, telling words apart and gathering ids are done for many
    texts at once; Python sees the distinct words.
    """

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.tokenizer, self.dtype, self.known = Tokenizer.from_file(path), np.dtype(dtype), Recent(CACHE_WORDS)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # what encode() relies on; any other tokenizer gets whole texts
        special = all(t["content"].startswith("<") and not t["normalized"] for t in told["added_tokens"])
        self.by_words = special and [told["normalizer"], told["pre_tokenizer"], told["model"]["type"], told["model"].get("dropout")] == [NORMALIZER, PRE_TOKENIZER, "BPE", None]

    def library(self, pieces: list[bytes]) -> None:
        """Ids of pieces without white space, many to a call; word numbers, else offsets, tell whose they are."""
        groups = [pieces[i : i + 512] for i in range(0, len(pieces), 512)]
        width, known = self.dtype.itemsize, self.known
        texts = [b"\n".join(g).decode() for g in groups]
        for group, text, got in zip(groups, texts, self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            data, of = np.array(got.ids, self.dtype).tobytes(), np.array(got.word_ids, np.int64)
            if len(of) and of[-1] == len(group) - 1:  # a piece is one word to the library's split
                at = (np.searchsorted(of, np.arange(1, len(group) + 1)) * width).tolist()
            else:
                begin = np.array(got.offsets, np.int64)[:, 0] if got.ids else np.empty(0, np.int64)
                ends = np.flatnonzero(np.frombuffer((text + "\n").encode("utf-32-le"), np.uint32) == 10)
                at = (np.searchsorted(begin, ends) * width).tolist()
            known.update(zip(group, [data[x:y] for x, y in zip([0, *at[:-1]], at, strict=True)], strict=True))

    def learn(self, words: list[bytes]) -> None:
        """Plain words go to the library in lower case and in the pieces that its split pattern cuts, so variants of a word share them."""
        letters, ended, cut, rest = [], {}, {}, []
        for w in words:
            if w.isalpha():  # of bytes: ASCII letters
                letters.append(w)
            elif w[:-1].isalpha() and w[-1:] in b".,;:!?":
                ended[w] = w[:-1].lower()
            elif PLAIN.fullmatch(t := w.decode()):
                cut[w] = [x.encode() for x in PIECES.findall(t.lower())]
            else:
                rest.append(w)
        lower, known = [w.lower() for w in letters], self.known
        self.library(known.absent({*lower, *ended.values(), *chain.from_iterable(cut.values()), *(w[-1:] for w in ended)}))
        piece = known.__getitem__
        known.update(zip(letters, map(piece, lower), strict=True))
        known.update((w, piece(x) + piece(w[-1:])) for w, x in ended.items())
        known.update((w, b"".join(map(piece, pieces))) for w, pieces in cut.items())
        for w, got in zip(rest, self.tokenizer.encode_batch([w.decode() for w in rest], add_special_tokens=False), strict=True):
            known[w] = np.array(got.ids, self.dtype).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's ids end."""
        if not self.by_words:
            got = [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([*got, np.empty(0, self.dtype)]), np.cumsum([len(x) for x in got], dtype=np.int64)
        lower = pc.if_else(pc.match_substring(texts, "<"), texts, pc.ascii_lower(texts))  # "<" may begin a special token, which has a case
        split = pc.ascii_split_whitespace(lower)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        self.learn(self.known.lacking(words))
        got = list(map(self.known.__getitem__, words))
        flat = np.frombuffer(b"".join(got), self.dtype)
        length = np.fromiter(map(len, got), np.int64, len(got)) // self.dtype.itemsize
        begin, of = np.cumsum(length) - length, coded.indices.to_numpy()
        each = length[of]
        ends = np.r_[0, np.cumsum(each)]
        ids = flat[np.repeat(begin[of] - ends[:-1], each) + np.arange(ends[-1])]
        return ids, ends[np.cumsum(pc.list_value_length(split).to_numpy())]


def by_bytes(texts: pa.Array, most: int = SLICE) -> Iterator[slice]:
    """Runs of texts of at most so many bytes together, a longer text alone."""
    ends, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
    while at < len(texts):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        yield slice(at, to := max(to, at + 1))
        at = to


def marks(ids: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash's top bits are zero, for many documents on end: a chunk has more ids than the
    hash looks back on, so a mark that counts never depends on the document before."""
    h = GEAR[ids & 0xFFFF]
    for shift in (1, 2, 4, 8, 16):
        if len(h) > shift:
            h = h.copy()
            h[shift:] += h[:-shift] << np.uint32(shift)
    return np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1


def cuts(marked: list[int], n: int) -> list[int]:
    """Ends of the chunks of n ids: at marks, between the least and largest length."""
    ends, start = [], 0
    for m in marked:
        while m - start > MAX_IDS:
            start += MAX_IDS
            ends.append(start)
        if m - start >= MIN_IDS:
            start = m
            ends.append(m)
    while n - start > MAX_IDS:
        start += MAX_IDS
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def merkle_root(leaves: list[bytes]) -> bytes:
    """Binary Merkle tree; an odd node moves up unchanged."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def digest_of(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=20).digest()


ENTRY = "key binary, payload binary, doc_id long, n_tokens long, digests array<binary>, ends array<long>, root binary"


def _encode(path: str, end_id: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, width = of_process(WordEncoder, path, dtype), np.dtype(dtype).itemsize
        sent: set[bytes] = set()
        task, count = TaskContext.get().partitionId(), 0
        for doc_ids, texts in ((b.column(0)[part], t[part]) for b in batches for t in [pc.fill_null(b.column(1), "")] for part in by_bytes(t)):
            rows: list[tuple] = []
            every, to = encoder.encode(texts)
            ids, stops = np.insert(every, to, end_id), to + np.arange(1, len(to) + 1)
            begins, data, found = np.r_[0, stops[:-1]], ids.tobytes(), marks(ids)
            low, high = np.searchsorted(found, begins, "right"), np.searchsorted(found, stops, "right")
            for doc_id, x, y, i, j in zip(doc_ids.to_pylist(), begins.tolist(), stops.tolist(), low.tolist(), high.tolist(), strict=True):
                digests, at = [], 0
                ends = cuts((found[i:j] - x).tolist() if y - x >= MIN_IDS else [], y - x)
                for e in ends:
                    payload = data[(x + at) * width : (x + e) * width]
                    digests.append(d := digest_of(payload))
                    at = e
                    if d not in sent:
                        sent.add(d)
                        rows.append((d, payload, None, None, None, None, None))
                if len(sent) > 200_000:
                    sent.clear()
                count += 1
                rows.append((b"R%d-%d" % (task, count), None, doc_id, at, digests, ends, merkle_root(digests)))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "payload", "doc_id", "n_tokens", "digests", "ends", "root"])

    return run


def write_store(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, dtype: str = "<u2") -> str:
    """Encode ``docs`` (doc_id, text), write the store and return its folder. ``dtype``: of the ids in the payloads."""
    spark = docs.sparkSession
    path = path or shared_dir(spark, "token-store")
    entries = docs.select("doc_id", "text").mapInArrow(_encode(tokenizer, end_id, dtype), ENTRY)
    # chunks and recipes share one shuffle, so the texts are encoded once
    once = entries.groupBy("key").agg(*(F.first(c).alias(c) for c in ("payload", "doc_id", "n_tokens", "digests", "ends", "root")))
    raw = write(once.withColumn("kind", F.when(F.col("payload").isNotNull(), "chunk").otherwise("recipe")), f"{path}/raw", ["kind"])
    recipes = raw.where("kind = 'recipe'").select("doc_id", "n_tokens", "digests", "ends", "root")
    ordered = recipes.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")
    written = write(ordered.withColumn("segment", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), f"{path}/recipes")
    write(manifest_of(written), f"{path}/manifest")
    return path


def _node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots = [merkle_root([x["leaf"] for x in sorted(l, key=lambda x: x["at"])]) for l in batch.column("l").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("segment", "block", "n")), pa.array(roots, pa.binary())], ["segment", "block", "n", "root"])


def manifest_of(recipes: DataFrame) -> DataFrame:
    """segment, block, n (children), root of every node. Blocks hold BLOCK recipes; a segment's node has no block, the store's neither."""
    kind = "segment int, block long, n long, root binary"

    def above(nodes: DataFrame, *by: str) -> DataFrame:
        grouped = nodes.groupBy(*by).agg(F.collect_list(F.struct("at", "leaf")).alias("l"), F.count("*").alias("n"))
        if "block" not in by:
            grouped = grouped.withColumn("block", F.lit(None).cast("long"))
        if "segment" not in by:
            grouped = grouped.withColumn("segment", F.lit(None).cast("int"))
        return grouped.select("segment", "block", "n", "l").mapInArrow(_node, kind)

    at = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    leaf = F.concat("root", F.encode(F.col("n_tokens").cast("string"), "utf-8"))
    leaves = recipes.select("segment", F.floor(at / BLOCK).alias("block"), "at", leaf.alias("leaf"))
    blocks = stage(above(leaves, "segment", "block"), "blocks")
    segments = stage(above(blocks.select("segment", F.col("block").alias("at"), F.col("root").alias("leaf")), "segment"), "segments")
    store = above(segments.select(F.col("segment").cast("long").alias("at"), F.col("root").alias("leaf")))
    return blocks.unionByName(segments).unionByName(store)


def verify_manifest(spark, path: str) -> None:
    """Raise unless the tree over the recipes equals the written manifest in every node."""
    recipes = spark.read.parquet(f"{path}/recipes")
    kind = "segment int, block long, n long, root binary"
    there, now = spark.read.schema(kind).parquet(f"{path}/manifest"), manifest_of(recipes)
    changed = there.exceptAll(now).unionByName(now.exceptAll(there)).limit(3).collect()
    if changed:
        raise ValueError(f"the recipes do not match the manifest, first at {[(r.segment, r.block) for r in changed]}")


def read_index(spark, path: str) -> DataFrame:
    """Recipes with ``start``: the ids of all documents before. Totals of segments are few rows; sums run inside segments."""
    recipes = spark.read.parquet(f"{path}/recipes")
    totals = recipes.groupBy("segment").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("segment", (F.sum("total").over(Window.orderBy("segment")) - F.col("total")).alias("before"))
    inside = Window.partitionBy("segment").orderBy("at")
    starts = recipes.select("segment", "at", "n_tokens", (F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("inner"))
    return starts.join(small(before), "segment").select("at", "n_tokens", (F.col("before") + F.col("inner")).alias("start"))


def _zero_tables() -> np.ndarray:
    """tables[k][b][v]: the CRC-32 register after 2**k zero bytes, from a register with byte ``b`` equal to ``v``."""
    out = np.zeros((40, 4, 256), np.uint32)
    step = np.zeros(256, np.uint32)
    for v in range(256):
        c = v
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        step[v] = c
    for b in range(4):
        x = np.arange(256, dtype=np.uint32) << np.uint32(8 * b)
        out[0, b] = (x >> np.uint32(8)) ^ step[x & np.uint32(255)]
    for k in range(1, 40):
        for b in range(4):
            out[k, b] = _apply(out[k - 1], out[k - 1, b])
    return out


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & np.uint32(255)] ^ tables[1][(crc >> np.uint32(8)) & np.uint32(255)] ^ tables[2][(crc >> np.uint32(16)) & np.uint32(255)] ^ tables[3][crc >> np.uint32(24)]


ZERO = _zero_tables()


def shift_crc(crc: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """What a part's CRC-32 adds (by xor) to the CRC-32 of the whole when ``follow`` bytes come after it."""
    crc, follow = crc.astype(np.uint32), follow.astype(np.int64)
    for k in range(int(follow.max(initial=0)).bit_length()):
        hit = (follow >> k) & 1 == 1
        crc[hit] = _apply(ZERO[k], crc[hit])
    return crc


def stored_chunks(spark, path: str) -> DataFrame:
    return spark.read.schema(f"{ENTRY}, kind string").parquet(f"{path}/raw").where("kind = 'chunk'").select("key", "payload")


def _read_chunks(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs, ns = [], []
            for key, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest_of(payload) != key:
                    raise ValueError("a stored chunk does not match its digest")
                ids = np.frombuffer(payload, dtype)
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                ns.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crcs, pa.int64()), pa.array(ns, pa.int32())], ["key", "crc", "n"])

    return run


def _check_recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for digests, root in zip(batch.column("digests").to_pylist(), batch.column("root").to_pylist(), strict=True):
            if merkle_root(digests) != root:
                raise ValueError("a recipe does not match its Merkle root")
        yield batch


def _shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.column("crc").null_count:
            raise ValueError("a recipe names a chunk that is not in the store")
        crc = shift_crc(batch.column("crc").to_numpy(), batch.column("follow").to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("doc_id"), pa.array(crc.astype(np.int64)), batch.column("n")], ["at", "doc_id", "part", "n"])


def read_digests(spark, path: str, dtype: str = "<u2") -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files.

    Each stored chunk is read and checked against its digest once; documents then need
    only the chunk's length and CRC-32, since CRCs of parts combine by xor.
    """
    verify_manifest(spark, path)
    chunks = stored_chunks(spark, path).mapInArrow(_read_chunks(dtype), "key binary, crc long, n int")
    recipes = spark.read.parquet(f"{path}/recipes").select("at", "doc_id", "n_tokens", "digests", "ends", "root")
    recipes = recipes.mapInArrow(_check_recipes, recipes.schema)
    parts = recipes.select("at", "doc_id", "n_tokens", F.explode(F.arrays_zip(F.col("digests").alias("d"), F.col("ends").alias("e"))).alias("x"))
    parts = parts.select("at", "doc_id", F.col("x.d").alias("key"), ((F.col("n_tokens") - F.col("x.e")) * 4).alias("follow"))
    shifted = parts.join(chunks, "key", "left").select("at", "doc_id", "crc", "follow", "n").mapInArrow(_shift, "at long, doc_id long, part long, n int")
    whole = shifted.groupBy("at").agg(F.first("doc_id").alias("doc_id"), F.expr("bit_xor(part)").alias("ids_crc32"), F.sum("n").alias("got"))
    index = read_index(spark, path)
    length = F.when(F.col("got") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document's chunks do not have its recorded length")))
    return index.join(whole, "at", "left").select("doc_id", "start", length.alias("n_tokens"), "ids_crc32")


def _join(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts, n in zip(batch.column("parts").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True):
                if any(p["payload"] is None or digest_of(p["payload"]) != p["key"] for p in parts):
                    raise ValueError("a chunk is not in the store or does not match its digest")
                ids = np.frombuffer(b"".join(p["payload"] for p in sorted(parts, key=lambda p: p["i"])), dtype).astype(np.int64)
                if len(ids) != n:
                    raise ValueError("a document's chunks do not have its recorded length")
                out.append(ids)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return run


def read_documents(spark, path: str, dtype: str = "<u2") -> DataFrame:
    """doc_id and the whole array of ids of every document, rebuilt from recipes and chunks and verified like the digests."""
    verify_manifest(spark, path)
    recipes = spark.read.parquet(f"{path}/recipes").select("at", "doc_id", "n_tokens", "digests", "ends", "root")
    recipes = recipes.mapInArrow(_check_recipes, recipes.schema)
    parts = recipes.select("at", "doc_id", "n_tokens", F.posexplode("digests").alias("i", "key")).join(stored_chunks(spark, path), "key", "left")
    whole = parts.groupBy("at").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.collect_list(F.struct("i", "key", "payload")).alias("parts"))
    return whole.select("doc_id", "n_tokens", "parts").mapInArrow(_join(dtype), "doc_id long, ids array<long>")
