import zlib
from collections import Counter

import pytest

from docketloom.llm import queries, sharding
from docketloom.llm.common import shared_dir
from tests.llm import samples


def laws(rows, docs, shards):
    counts = Counter(r.shard for r in rows)
    assert len(rows) == len(docs) and all(0 <= s < shards for s in counts)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


@pytest.mark.parametrize("extra", [False, True])
@pytest.mark.parametrize("bucket_bytes", [100, 1 << 20])
def test_rows_law(spark, extra, bucket_bytes):
    docs = samples.table(spark, extra)
    rows = sharding.shuffle_into_shards(docs, shards=4, bucket_bytes=bucket_bytes).collect()
    laws(rows, docs.collect(), 4)
    assert sorted(map(str, (r.record for r in rows))) == sorted(map(str, docs.collect()))
    for r in rows:
        data = (r.record.text or "").encode()
        assert (r["size"], r.text_crc32) == (len(data) + 8, zlib.crc32(data))


def test_documents(spark):
    rows = queries.op9_sharding(spark, samples.SF).collect()
    laws(rows, samples.documents(spark).collect(), 24)
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order != sorted(order) and {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}


def test_equal_rows_fill_all_buckets(spark):
    """Rows without ids and with equal texts spread evenly, so no task gets them all."""
    path = f"{shared_dir(spark, 't')}"
    docs = spark.range(0, 3000, numPartitions=3).selectExpr("cast(null as long) doc_id", "'the same text' text")
    rows = sharding.shuffle_into_shards(docs, shards=4, bucket_bytes=3000 * 21 // 30, path=path).collect()
    sizes = [r["count"] for r in spark.read.parquet(f"{path}/mixed").groupBy("bucket").count().collect()]
    assert len(rows) == 3000 and len(sizes) == 30 and max(sizes) < 200


def test_empty_table(spark):
    assert sharding.shuffle_into_shards(samples.empty(spark)).count() == 0


def test_any_column_type(spark):
    docs = spark.sql("select id doc_id, concat('text ', id % 7) text, map('k', id) m, array(map(1, 2)) am, date'2024-01-01' d from range(50)")
    rows = sharding.shuffle_into_shards(docs, shards=3, bucket_bytes=200).collect()
    laws(rows, docs.collect(), 3)
    assert {(r.record.doc_id, r.record.m["k"]) for r in rows} == {(i, i) for i in range(50)}


def test_a_seed_gives_the_same_shards_for_any_layout(spark):
    docs = samples.documents(spark).unionByName(samples.table(spark)).unionByName(samples.table(spark))  # equal rows too
    places = []
    for files, partitions in ((2, "3"), (7, "9")):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        path = shared_dir(spark, "layout")
        docs.repartition(files, "n_chars").write.parquet(path)
        rows = sharding.shuffle_into_shards(spark.read.parquet(path), shards=5, bucket_bytes=50_000).collect()
        places.append(sorted((r.shard, r.slot, str(r.record)) for r in rows))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert places[0] == places[1]
    assert places[0] != sorted((r.shard, r.slot, str(r.record)) for r in sharding.shuffle_into_shards(docs, shards=5, seed=18, bucket_bytes=50_000).collect())
