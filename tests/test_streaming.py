"""A ledger stream that is killed and goes on."""

import random

import pytest
from pyspark.sql import functions as F

from docketloom.plans import stream_queries
from docketloom.streaming import ledger

SCHEMA = "document long, version int, item string, ts long, note string"


def test_a_killed_stream_goes_on(spark, tmp_path):
    r = random.Random(6)
    rows = [(r.randrange(4), r.randrange(3), r.choice("abc"), r.randrange(40), r.choice([None, "x", "y"])) for _ in range(400)]
    events = spark.createDataFrame(rows, SCHEMA)
    for i in range(4):
        events.where(F.pmod(F.hash("ts", "item", "note"), F.lit(4)) == i).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    keys = ["document", "version", "item"]
    source = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    sink, checkpoint = str(tmp_path / "out"), str(tmp_path / "ck")

    def killed(batch, number):
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        if number == 1:
            raise RuntimeError("killed")

    broken = ledger.latest_states(source(), keys).writeStream.outputMode("append").foreachBatch(killed).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="killed"):
        broken.awaitTermination(120)
    half = ledger.followed(spark, sink, keys).count()
    assert half > 0
    ledger.follow(source(), keys, checkpoint, sink).awaitTermination(120)
    ledger.follow(source(), keys, checkpoint, sink).awaitTermination(120)  # nothing new
    got = {(x.document, x.version, x.item): (x.ts, x.note) for x in ledger.followed(spark, sink, keys).collect()}
    want = {}
    for d, v, i, ts, note in rows:
        want[d, v, i] = max(want.get((d, v, i), (-1, None)), (ts, note), key=lambda x: (x[0], x[1] is not None, x[1] or ""))
    assert got == want
    last = ledger.of_last_version(ledger.followed(spark, sink, keys))
    newest = {}
    for d, v, *_ in rows:
        newest[d] = max(newest.get(d, 0), v)
    assert {(x.document, x.version) for x in last.collect()} == set(newest.items())
    counts = ledger.followed(spark, sink, keys).agg(F.max("n_events")).first()[0]
    assert 0 < counts <= 400


def test_a_stream_without_python_goes_on(spark, tmp_path, monkeypatch):
    """Keys come back in later batches, some with older events; a stop in between changes nothing, and no Python step runs for a key."""
    monkeypatch.setattr(ledger, "latest_states", None)
    r = random.Random(8)
    rows = [(r.randrange(3), 0, r.choice(["a", "b", None]), r.choice([None, *range(30)]), r.choice([None, "x", "y"])) for _ in range(200)]
    for i in range(2):
        spark.createDataFrame(rows[i * 100 : i * 100 + 100], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        ledger.follow(source, ["document", "item"], str(tmp_path / "ck"), str(tmp_path / "out"), changes=False).awaitTermination(120)
    got = {(x.document, x["item"]): (x.ts, x.version, x.note, x.n_events) for x in ledger.followed(spark, str(tmp_path / "out"), ["document", "item"]).collect()}
    want = {}
    for d, v, i, ts, note in rows:
        old = want.get((d, i), (None, None, None, 0))
        best = max(old[:3], (ts, v, note), key=lambda x: [(y is not None, y or 0) if y != "x" and y != "y" else (True, y) for y in x])
        want[d, i] = (*best, old[3] + 1)
    assert got == want


def test_ledger_stream_runs_no_python_for_a_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "latest_states", None)
    spark.sql("select id % 7 as user_id, concat('k', id % 2) as event_type, id as event_id, timestamp_micros(id * 37 % 50) as ts from range(300)").write.parquet(str(tmp_path / "events.parquet"))
    want = {}
    for i in range(300):
        want[i % 7, f"k{i % 2}"] = max(want.get((i % 7, f"k{i % 2}"), (-1, -1)), (i * 37 % 50, i))
    got = {(x.user_id, x.event_type): (x["at"], x.event_id) for x in stream_queries.ledger_stream(spark, str(tmp_path)).collect()}
    assert got == want
