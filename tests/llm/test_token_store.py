import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketloom.llm import queries, token_store
from docketloom.llm.common import shared_dir
from tests.llm import samples


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, out, encode):
    want, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = encode(text)
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(map(tuple, out.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    assert got == want


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_texts(spark, encode, extra):
    docs = samples.table(spark, extra)
    path = token_store.write_store(docs, queries.tokenizer_path("word_bpe_49k.json"), 2)
    check([(r.doc_id, r.text) for r in docs.collect()], token_store.read_digests(spark, path), encode)
    want = sorted(tuple(encode(r.text)) for r in docs.collect())
    assert sorted(tuple(r.ids) for r in token_store.read_documents(spark, path).collect()) == want


def test_documents(spark, encode):
    rows = [(r.doc_id, r.text) for r in samples.documents(spark).collect()]
    check(rows, queries.op1_token_store(spark, samples.SF), encode)


def test_empty_table(spark):
    path = token_store.write_store(samples.empty(spark), queries.tokenizer_path("word_bpe_49k.json"), 2)
    assert token_store.read_digests(spark, path).count() == 0


def test_shared_chunks_are_stored_once(spark):
    docs = spark.createDataFrame([(i, samples.sentence(3000)) for i in range(8)], "doc_id long, text string").repartition(4)
    path = token_store.write_store(docs, queries.tokenizer_path("word_bpe_49k.json"), 2)
    keys = [bytes(r.key) for r in token_store.stored_chunks(spark, path).collect()]
    recipe = spark.read.parquet(f"{path}/recipes").first()
    assert len(keys) == len(set(keys)) == len({bytes(d) for d in recipe.digests})


def test_a_damaged_chunk_is_noticed(spark):
    run = token_store._read_chunks("<u2")
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([b"x" * 20]), pa.array([b"ab"])], ["key", "payload"])
    with pytest.raises(ValueError):
        list(run([batch]))


@pytest.mark.parametrize("damage", ["chunk", "recipe", "length", "node"])
def test_what_is_missing_is_noticed(spark, damage):
    """A store without one chunk, without one recipe, with another length or with another node does not read."""
    docs = spark.createDataFrame([(i, samples.sentence(600 + i, 1, i)) for i in range(6)], "doc_id long, text string").repartition(2)
    path = token_store.write_store(docs, queries.tokenizer_path("word_bpe_49k.json"), 2)
    bad = shared_dir(spark, "damaged")
    raw, recipes, manifest = (spark.read.parquet(f"{path}/{x}") for x in ("raw", "recipes", "manifest"))
    key = raw.where("kind = 'chunk'").first().key
    if damage == "chunk":
        raw = raw.where(F.col("key") != F.lit(bytes(key)))
    elif damage == "recipe":
        recipes = recipes.where("doc_id <> 3")
    elif damage == "length":
        recipes = recipes.withColumn("n_tokens", F.when(F.col("doc_id") == 3, F.col("n_tokens") - 1).otherwise(F.col("n_tokens")))
    else:
        manifest = manifest.withColumn("root", F.when(F.col("segment").isNull(), F.lit(b"x")).otherwise(F.col("root")))
    raw.write.partitionBy("kind").parquet(f"{bad}/raw")
    recipes.write.parquet(f"{bad}/recipes")
    manifest.write.parquet(f"{bad}/manifest")
    for read in (token_store.read_digests, token_store.read_documents):
        assert read(spark, path).count() == 6
        with pytest.raises(Exception, match="manifest|chunk|length"):
            read(spark, bad).collect()


def test_manifest_is_a_tree(spark):
    docs = spark.range(0, 2500, numPartitions=3).selectExpr("id as doc_id", "concat('w', id) as text")
    path = token_store.write_store(docs, queries.tokenizer_path("word_bpe_49k.json"), 2)
    nodes = spark.read.parquet(f"{path}/manifest").collect()
    blocks, segments, store = [r for r in nodes if r.block is not None], [r for r in nodes if r.block is None and r.segment is not None], [r for r in nodes if r.segment is None]
    assert sum(r.n for r in blocks) == 2500 and len(blocks) == sum(r.n for r in segments) and len(store) == 1 and store[0].n == len(segments)
    assert bytes(store[0].root) == token_store.merkle_root([bytes(r.root) for r in sorted(segments, key=lambda r: r.segment)])


def test_another_tokenizer(spark):
    """A tokenizer that words can't be told apart for gets whole texts."""
    from tokenizers import Tokenizer

    file = queries.tokenizer_path("byte_bpe_50k.json")
    t, docs = Tokenizer.from_file(file), samples.table(spark)
    path = token_store.write_store(docs, file, 2)
    want = sorted((*t.encode(r.text or "", add_special_tokens=False).ids, 2) for r in docs.collect())
    assert sorted(tuple(r.ids) for r in token_store.read_documents(spark, path).collect()) == want


def test_crc_parts_combine():
    a, b = b"some bytes", b"and others" * 1000
    parts = token_store.shift_crc(np.array([zlib.crc32(a), zlib.crc32(b)]), np.array([len(b), 0]))
    assert int(parts[0] ^ parts[1]) == zlib.crc32(a + b)


def test_cuts_of_documents_on_end_are_those_of_each():
    rng = np.random.default_rng(4)
    lengths = [0, 1, 127, 128, 129, 600, 5000, 40_000, 3]
    docs = [rng.integers(0, 50_000, n).astype("<u2") for n in lengths]
    ends = np.cumsum(lengths)
    found = token_store.marks(np.concatenate(docs))
    for ids, stop in zip(docs, ends.tolist(), strict=True):
        start = stop - len(ids)
        own = [m - start for m in found.tolist() if start < m <= stop]
        cut = token_store.cuts(own, len(ids))
        assert cut == token_store.cuts(token_store.marks(ids).tolist(), len(ids)) and (cut[-1:] == [len(ids)] or not len(ids))
        assert all(token_store.MIN_IDS <= b - a <= token_store.MAX_IDS for a, b in zip([0, *cut], cut[:-1], strict=False))
