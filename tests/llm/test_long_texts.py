"""A text of megabytes, map columns and names that clash, through the operators that have no such test of their own."""

import hashlib
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from docketloom.llm import bpe, exact_dedup, mixing, ngram_join, pieces, quality_rules, queries, secret_scan, sharding, token_store
from docketloom.llm.common import shared_dir

LONG = " ".join(f"word{i % 5003}{'x' * (i % 4)} part{i // 7}." + ("\n" if i % 50 == 0 else "") for i in range(120_000)) + " token=abcdef0123456789 end"
TEXTS = {1: LONG, 2: LONG + " more", 3: LONG, 4: "short text", 5: None, 6: ""}
MOST = 90


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(i, t) for i, t in TEXTS.items()], "doc_id long, text string")
    more = {"m": F.create_map(F.lit("k"), "doc_id"), "h": F.lit("a"), "place": F.lit(1), "digest": F.lit("d"), "blob": F.lit("b"), "key": F.lit("c"), "source": F.lit("s"), "_count": F.lit(2), "ids": F.array(F.lit(1)), "n_tokens": F.lit(9)}
    return rows.withColumns(more).persist()


def timed(frame):
    began = time.time()
    rows = frame.collect()
    assert time.time() - began < MOST
    return {r["doc_id"] if "doc_id" in r.asDict() else r["record"]["doc_id"]: r for r in rows}


def test_encoders(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in TEXTS.items()}
    got = timed(bpe.encode_decode(docs, queries.tokenizer_path("byte_bpe_50k.json")))
    assert {i: r.n_tokens for i, r in got.items()} == want
    assert got[1].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    other = timed(pieces.encode_decode(docs, queries.tokenizer_path("piece_bpe_32k.model")))
    assert other[1].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest() and other[5].n_tokens == 2


def test_token_store(spark, docs):
    path = token_store.write_store(docs, queries.tokenizer_path("word_bpe_49k.json"), end_id=2)
    got = timed(token_store.read_digests(spark, path))
    assert len(got) == 6 and got[1].ids_crc32 == got[3].ids_crc32 and got[5].n_tokens == got[6].n_tokens == 1 and got[1].n_tokens > 200_000


def test_duplicates(docs):
    got = timed(exact_dedup.deduplicate(docs, keep="largest"))
    assert {i: (r.keep_id, r.group_size) for i, r in got.items()} == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1), 5: (6, 2), 6: (6, 2)}
    near = timed(ngram_join.near_duplicates(docs, num=75, den=100, shingle=5))
    words = re.findall(r"[^\x20\x09-\x0D]+", LONG)
    assert {i: r.component_id for i, r in near.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    assert near[1].n_shingles == len({tuple(words[k : k + 5]) for k in range(len(words) - 4)})


@pytest.mark.parametrize(("keep", "want"), [("smallest", {10: 1, 11: 2, 12: 9, 13: None}), ("largest", {10: 7, 11: 8, 12: 9, 13: None})])
def test_an_index_that_grows(spark, keep, want):
    """Two batches are taken in one after the other; what comes then is looked up in both."""
    digests = lambda pairs: exact_dedup.with_digest(spark.createDataFrame(pairs, "doc_id long, text string"))
    path = shared_dir(spark, "index")
    exact_dedup.ingest(digests([(1, "a"), (2, "b"), (5, "a")]), path, keep, limit=2, ranges=3)
    runs = exact_dedup.ingest(digests([(7, "a"), (8, "b"), (9, "c")]), path, keep, limit=2, ranges=3)
    assert runs.select("run").distinct().count() >= 2
    index = exact_dedup.compact(runs, path, keep)
    assert sorted(r.n for r in index.collect()) == [1, 2, 3]
    asked = digests([(10, "a"), (11, "b"), (12, "c"), (13, "d")])
    found = {r.doc_id: r.keep_id for r in exact_dedup.lookup(index, asked, 3).collect()}
    assert found == {i: k for i, k in want.items() if k is not None}


def test_scans_and_rules(spark, docs):
    got = timed(secret_scan.report(secret_scan.scan(docs, shared_dir(spark, "ledger"))))
    assert {i: r.n_assign for i, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0}
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    base = timed(quality_rules.judge(docs, labels))
    assert base[1].n_words == len(LONG.split()) and base[5].n_words == 0 and base[4].base_failed


def test_sharding_and_mixing(docs):
    got = timed(sharding.shuffle_into_shards(docs, shards=3))
    assert {i: (r["size"], r.text_crc32) for i, r in got.items()} == {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in TEXTS.items()}
    assert got[2].record.m == {"k": 2}
    rows = mixing.mix(docs, temperature=0.7, epochs=3.0, seed=1).collect()
    assert rows and {r.doc_id for r in rows} <= set(TEXTS) and all(r.text == TEXTS[r.doc_id] for r in rows)
