"""Removal of repeated passages by compaction of a de Bruijn graph of token k-mers.

A window is ``window`` consecutive words of one document. It goes when the same words also
start in a document with a smaller doc_id; a word goes when a window over it does.

1. Nodes. In each document the k-mers that are least (by hash) in some run of
   window - k + 1 consecutive k-mers are its anchors. Every window contains one, chosen by its
   words alone, so equal windows contain equal anchors at equal places. A node of the graph is
   an anchor's k-mer, an edge the words from one anchor to the end of the next.
2. Aggregation by node (map-side combining, so very common passages are no hot spot) gives the
   least and the greatest document, where the least has it, and whether one edge alone leaves and enters it. Nodes of
   one document need no more work.
3. Compaction. A Spark join brings the repeated nodes back to their documents, where a node joins the one before it
   if a nonbranching edge leads to it: runs of such nodes are paths, one row each. All windows inside a path occur in exactly the
   documents of its nodes, so a path is settled by one comparison.
4. Windows over repeated nodes that leave a path (at branches and
   ends) are compared one by one: grouped by their hashes, the least document wins, and hits that go on side by side
   in a document and its source become one span.
5. Verification by source coordinates. Every span names the place of its words in a smaller document. The words there are read
   again, whole spans by SHA-256, and only a span whose own words are the same is removed.

K-mers, edges and windows are found by 64-bit hashes; nothing is removed on their word alone. Edge cases: null and empty
texts have no words; shorter documents than a window lose nothing; a null doc_id counts as
larger than any other; documents with equal doc_ids never remove words from each other, nor
does a document from itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, mix, of_process, shared_dir, sliding, small, stage, window_hashes, write
from .ngram_join import texts_of

WINDOW, K = 50, 14
LAST = 2**63 - 1


def anchors(h: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and k-mer hashes of the anchors of a document's word hashes."""
    width = window - k + 1
    kmers = window_hashes(h, k)
    if len(kmers) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least = sliding(kmers, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(sliding(np.r_[pad, least, pad], width, np.maximum) == kmers)
    return at, kmers[at]


def edges(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the words from each anchor to the end of the next; one fewer than anchors."""
    out = np.empty(max(0, len(at) - 1), np.uint64)
    gaps = np.diff(at)
    for gap in np.unique(gaps).tolist():
        i = np.flatnonzero(gaps == gap)
        out[i] = mix(window_hashes(h, gap + k)[at[i]] ^ np.uint64(gap))
    return out


def rank(doc_id: int | None) -> int:
    return LAST if doc_id is None else doc_id


DOC = "uid long, doc_id long, rank long, text_key long, n_words long, sha string, at array<int>, node array<long>, edge array<long>"


def _graph(k: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, uid = of_process(WordHashes), TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for doc_id, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), texts_of(batch), strict=True):
                words = text.split()
                h = hashes.of(words)
                at, node = anchors(h, k, window)
                edge = edges(h, at, k)
                rows.append((uid, doc_id, rank(doc_id), key, len(words), hashlib.sha256(b" ".join(words)).hexdigest(), at.astype(np.int32), node.view(np.int64), edge.view(np.int64)))
                uid += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            cols = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in DOC.split(", ")])

    return run


def _windows(k: int, window: int):
    """Per document with repeated nodes (the first and last node of each run): its windows that no path settles, to compare one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = of_process(WordHashes)
        for batch in batches:
            out = [[np.empty(0, np.int64)] for _ in range(4)]
            for row, text in zip(batch.select(["uid", "rank", "runs"]).to_pylist(), texts_of(batch), strict=True):
                h = hashes.of(text.split())
                windows = np.zeros(max(0, len(h) - window + 1) + 1, bool)
                inside = np.zeros(len(windows), bool)
                for x in row["runs"]:
                    windows[max(0, x["start"] + k - window) : x["end"] - k + 1] = True
                    if x["end"] - x["start"] >= window:
                        inside[x["start"] : x["end"] - window + 1] = True
                windows[-1] = False  # one past the last window
                p = np.flatnonzero(windows & ~inside)
                for col, v in zip(out, (np.full(len(p), row["uid"]), np.full(len(p), row["rank"]), p, window_hashes(h, window)[p].view(np.int64)), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], ["uid", "rank", "start", "hash"])

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the words of a source at the places that are asked for; null where it has too few words."""
    for batch in batches:
        out = [[], [], [], []]
        for uid, wanted, text in zip(batch.column("uid").to_pylist(), batch.column("wanted_spans").to_pylist(), texts_of(batch), strict=True):
            words = text.split()
            for w in wanted:
                part = words[w["start"] : w["start"] + w["n"]]
                for col, v in zip(out, (uid, w["start"], w["n"], hashlib.sha256(b" ".join(part)).digest() if len(part) == w["n"] else None), strict=True):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["src_uid", "src_start", "n", "digest"])


def _cut(full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, removed, shas, kept_texts = [], [], [], []
            for uid, spans, text in zip(batch.column("uid").to_pylist(), batch.column("spans").to_pylist(), texts_of(batch), strict=True):
                words = text.split()
                gone = np.zeros(len(words) + 1, np.int64)
                for s in spans:
                    if hashlib.sha256(b" ".join(words[s["start"] : s["end"]])).digest() == s["digest"]:  # the words at its source
                        gone[s["start"]] += 1
                        gone[s["end"]] -= 1
                gone = (np.cumsum(gone)[:-1] > 0).tolist()
                kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
                uids.append(uid)
                removed.append(sum(gone))
                shas.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode())
            cols = [pa.array(uids, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())] + ([pa.array(kept_texts, pa.string())] if full else [])
            yield pa.RecordBatch.from_arrays(cols, ["uid", "n_removed", "kept_sha256", "kept_text"][: len(cols)])

    return run


def compact(back: DataFrame, k: int) -> DataFrame:
    """Paths of repeated nodes: uid, rank, start, end, src. ``back``: uid, rank, i, at, src, one_out, one_in of repeated nodes in their documents.

    A node goes on with the path of the one before it (i - 1) if a single edge leaves that and a single one enters it. Documents are
    windows of their own; a path keeps the source of its first node.
    """
    order = Window.partitionBy("uid").orderBy("i")
    joins = (F.lag("i").over(order) == F.col("i") - 1) & F.lag("one_out").over(order) & F.col("one_in")
    runs = back.withColumn("new", (~F.coalesce(joins, F.lit(False))).cast("int")).withColumn("run", F.sum("new").over(order))
    paths = runs.groupBy("uid", "run").agg(F.min("rank").alias("rank"), F.min("at").alias("start"), (F.max("at") + k).alias("end"), F.min_by("src", "i").alias("src"))
    return paths.select("uid", "rank", "start", "end", "src")


def spans_of(hits: DataFrame, window: int) -> DataFrame:
    """Hits (uid, start, src_uid, src_start) that go on side by side in a document and its source, as spans (uid, start, end, src_uid, src_start)."""
    aside = hits.withColumn("shift", F.col("start") - F.col("src_start"))
    order = Window.partitionBy("uid", "src_uid", "shift").orderBy("start")
    island = aside.withColumn("island", F.col("start") - F.dense_rank().over(order))
    return island.groupBy("uid", "src_uid", "shift", "island").agg(F.min("start").alias("start"), (F.max("start") + window).alias("end"), F.min("src_start").alias("src_start")).drop("shift", "island")


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = K, full: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; ``full`` adds kept_text for documents that lose words."""
    path = shared_dir(docs.sparkSession, "substring-dedup")
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    graph = write(docs.mapInArrow(_graph(k, window), DOC), f"{path}/graph")
    none = F.array(F.lit(0).cast("long"))
    around = F.arrays_zip(F.col("node").alias("h"), F.col("at").alias("at"), F.concat("edge", none).alias("out"), F.concat(none, "edge").alias("into"))
    seen = graph.where(F.size("node") > 0).select("uid", "rank", F.explode(around).alias("x")).select("uid", "rank", "x.h", "x.at", "x.out", "x.into")
    nodes = seen.groupBy("h").agg(F.min(F.struct("rank", "uid", "at")).alias("src"), F.max("rank").alias("last"), F.min("out").alias("o1"), F.max("out").alias("o2"), F.min("into").alias("i1"), F.max("into").alias("i2"))
    nodes = nodes.where("src.rank < last").select("h", "src", F.expr("o1 = o2 and o1 <> 0").alias("one_out"), F.expr("i1 = i2 and i1 <> 0").alias("one_in"))
    nodes = write(nodes, f"{path}/nodes")
    places = graph.where(F.size("node") > 0).select("uid", "rank", F.posexplode(F.arrays_zip("node", "at")).alias("i", "x")).select("uid", "rank", "i", F.col("x.node").alias("h"), F.col("x.at").cast("long").alias("at"))
    paths = write(compact(places.join(small(nodes), "h").drop("h"), k), f"{path}/paths")

    def with_text(rows: DataFrame) -> DataFrame:
        """Rows (uid, doc_id, text_key, ...) with the texts of their documents; repeated rows may repeat."""
        ids = rows.select(F.col("doc_id").alias("wanted")).distinct()
        texts = docs.join(small(stage(ids, "ids")), F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
        return rows.select(F.col("doc_id").alias("wanted"), F.col("text_key").alias("wanted_key"), *[c for c in rows.columns if c not in ("doc_id", "text_key")]).join(
            texts, F.col("wanted").eqNullSafe(F.col("doc_id")) & (F.col("wanted_key") == F.col("text_key"))
        )

    own = graph.select("uid", "doc_id", "text_key")
    runs = paths.groupBy("uid").agg(F.min("rank").alias("rank"), F.collect_list(F.struct("start", "end")).alias("runs"))
    windows = write(with_text(write(own.join(runs, "uid"), f"{path}/runs")).mapInArrow(_windows(k, window), "uid long, rank long, start long, hash long"), f"{path}/windows")
    firsts = windows.groupBy("hash").agg(F.min(F.struct("rank", "uid", "start")).alias("src"), F.max("rank").alias("last")).where("src.rank < last").select("hash", "src")
    firsts = small(stage(firsts, "firsts"))
    hits = windows.join(firsts, "hash").where("src.rank < rank").select("uid", "start", F.col("src.uid").alias("src_uid"), F.col("src.start").alias("src_start"))
    settled = paths.where(f"end - start >= {window} and src.rank < rank").select("uid", "start", "end", F.col("src.uid").alias("src_uid"), F.col("src.at").cast("long").alias("src_start"))
    spans = write(settled.unionByName(spans_of(hits, window).select(settled.columns)).withColumn("n", F.col("end") - F.col("start")), f"{path}/spans")
    asked = spans.select(F.col("src_uid").alias("uid"), F.col("src_start").alias("start"), "n").distinct()
    asked = asked.groupBy("uid").agg(F.collect_list(F.struct("start", "n")).alias("wanted_spans"))
    sources = with_text(write(own.join(asked, "uid"), f"{path}/asked")).mapInArrow(_digests, "src_uid long, src_start long, n long, digest binary").dropDuplicates(["src_uid", "src_start", "n"])
    gone = spans.join(sources, ["src_uid", "src_start", "n"]).where("digest is not null").groupBy("uid").agg(F.collect_list(F.struct("start", "end", "digest")).alias("spans"))
    gone = write(own.join(gone, "uid"), f"{path}/gone")
    changed = with_text(gone).mapInArrow(_cut(full), "uid long, n_removed long, kept_sha256 string" + ", kept_text string" * full)
    out = graph.select("uid", "doc_id", "n_words", "sha").join(changed.dropDuplicates(["uid"]), "uid", "left")
    cols = ["doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")]
    return out.select(*cols, *(["kept_text"] if full else []))
