"""N-gram Jaccard self-join by parity sketches.

A document's set holds its distinct word shingles as 64-bit hashes. Two sets with Jaccard
similarity t or more differ in few shingles: |A xor B| <= (|A| + |B|)(1 - t)/(1 + t).

* Sketch words. In size band j (sizes below 4**j) a sketch has P = max(64, 4**j) words for
  ordinary and P for frequent shingles; each shingle is XORed into the word its hash chooses.
  A differing shingle changes one word, so the number of differing words is a lower bound of
  the symmetric difference.
* Pigeonhole join. Order the words: ordinary ones first. If A and B differ in fewer than q
  shingles, the first q nonzero words of each contain an equal one: the least word nonzero and
  equal in both has fewer than q nonzero words of A, and of B, before it, as each of those is
  changed by another differing shingle. With t = 3/4, q = n // 3 + 1 suffices for every
  partner of a set of n. A set that could have a larger partner in the next band joins there
  too; a set with fewer than q nonzero words (rare) also joins all others like it.
* Parity bits. One bit per shingle toggled in a bit sketch of 2n bits or more; the Hamming
  distance, also a lower bound, rules out most candidates. Sketches fold by XORing halves.
* Verification. Remaining pairs are checked by exact intersection of their hash sets.

Frequent shingles are found in a hashed sample of different texts; which ones count as frequent
affects speed only. Keys held by many sets (``group_limit``) don't give all their pairs. Sketches are
linear: a member's sketch XOR that of a centre is the sketch of what the two differ in, and of two members
A, B with differences DA, DB from one centre C the symmetric difference is DA xor DB. So

* members most of whose shingles no other member has can't link and leave;
* each large group gets a centre, the member that lies in most large groups, and every member's exact
  difference from it; small differences are links with the centre;
* two members that link with the centre need no more work. If A does not, a link of A and B requires
  2 |DA and DB| >= |DA| + |DB| - (|A| + |B|)(1 - t)/(1 + t) > 0: they share shingles in which both differ from the
  centre. Differences are ordered by how few members share a shingle, and members meet only in shingles
  at whose places that many more can still be shared. What all copies have in common is in no difference, hence is no key.

No link between different components is lost, hence components are exact. Links inside a component
are not all found: the operator gives components, not all pairs.

Rows travel to numbered buckets as packed arrays (6 bytes for each sketch word). Sets equal
within a task are sent once. Edge cases: null, empty and wordless texts have empty sets, link
with nothing and are their own component; texts of fewer than ``shingle`` words have one
shingle, the whole; null doc_ids take part and a component's id is its least non-null one;
repeated rows are one set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, mix, of_process, shared_dir, small, small_batches, stage, tidy, window_hashes, write
from .components import components

SHINGLE = 5
SAMPLE, FREQUENT, MOST_FREQUENT = 8, 4, 1 << 17
"""Different texts sampled for frequent shingles: one in SAMPLE; frequent: in FREQUENT of them or more; the bound on how many are told apart."""
GROUP_LIMIT = 8
SALTED, SLOTS, MOST_LEVELS = 256, 1024, 20_000
BUCKET_BYTES = 24 << 20
"""Bytes of text to a bucket of sketch words: at most two bands of a third of the shingles, 6 bytes each."""
MOST_WORDS = 1 << 17
"""Hashes of words that a worker keeps."""
PLACED_ROWS = 256
"""Differences that are placed at a time, each with up to some thousand rows."""
U = np.uint64


def shingles(words: list[bytes], hashes: WordHashes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a document."""
    if not words:
        return np.empty(0, U)
    h = hashes.of(words)
    return np.unique(window_hashes(h, k)) if len(h) >= k else mix(window_hashes(h, len(h)) ^ U(len(h)))


def set_id(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def band_of(n: int) -> int:
    j = 1
    while 4**j <= n:
        j += 1
    return j


def bits_of(s: np.ndarray) -> bytes:
    """The parity bits: a power of two of them, at least 2n."""
    size = max(64, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s >> U(20)).astype(np.int64) & (size - 1), minlength=size) & 1).astype(bool)).tobytes()


def hamming(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def sketch_keys(s: np.ndarray, frequent: np.ndarray, band: int) -> np.ndarray:
    """Join keys of a set in a band: its first n // 3 + 1 nonzero words, with their places."""
    q = len(s) // 3 + 1
    parts = max(64, 4**band)
    place = (mix(s ^ U(0x5BF03635)) & U(parts - 1)).astype(np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        place += parts * (frequent[at] == s)
    order = np.argsort(place, kind="stable")
    place, s = place[order], s[order]
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    words, place = np.bitwise_xor.reduceat(s, starts), place[starts]
    place, words = place[words != 0][:q], words[words != 0][:q]
    keys = mix(words ^ mix(place.astype(U) * U(64) + U(band)))
    return keys if len(keys) == q else np.r_[keys, mix(np.array([band], U) ^ U(0xDEF1C1E17))]


ROWS = "kind string, bucket int, base long, uid long, doc_id long, sid binary, n long, a binary, b binary"
NAMES = [x.split()[0] for x in ROWS.split(", ")]
KINDS = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


def _sketch(k: int, frequent: np.ndarray, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, base, sent = of_process(WordHashes, 0, MOST_WORDS), TaskContext.get().partitionId() << 33, set()
        for whole in batches:
            for at in range(0, len(whole), 4096):
                batch = whole.slice(at, 4096)
                rows, keys, owners = [], [], []
                for i, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True)):
                    s = shingles(text.lower().split(), hashes, k)
                    sid = set_id(s) if len(s) else None
                    rows.append(("doc", None, None, base + i, doc_id, sid, len(s), None, None))
                    if sid is None or sid in sent:
                        continue
                    sent.add(sid)
                    j = band_of(len(s))
                    got = sketch_keys(s, frequent, j)
                    if 4 * len(s) >= 3 * 4**j:
                        got = np.r_[got, sketch_keys(s, frequent, j + 1)]
                    rows.append(("set", None, None, base + i, None, sid, len(s), bits_of(s), None))
                    keys.append(got)
                    owners.append(np.full(len(got), i, np.uint16))
                if len(sent) > 300_000:
                    sent.clear()
                if keys:
                    key, owner = np.concatenate(keys), np.concatenate(owners)
                    bucket = ((key >> U(32)) % U(buckets)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    key, owner, bucket = (key & U(0xFFFFFFFF)).astype("<u4")[order], owner[order], bucket[order]
                    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
                    rows += [("key", int(bucket[x]), base, None, None, None, None, key[x:y].tobytes(), owner[x:y].tobytes()) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                base += len(batch)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)

    return run


def _pairs(limit: int):
    """Of a bucket's rows: pairs of sets with an equal key (key 0); of larger groups the members (v null)."""

    def run(table: pa.Table) -> pa.Table:
        key = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("a").to_pylist()])
        uid = np.concatenate([base + np.frombuffer(x, np.uint16).astype(np.int64) for base, x in zip(table.column("base").to_pylist(), table.column("b").to_pylist(), strict=True)])
        order = np.lexsort((uid, key))
        key, uid = key[order], uid[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[starts, len(key)])
        us, vs = [], []
        each = np.repeat(size, size)
        plain, hot = each <= limit, each > limit
        for d in range(1, min(limit, int(size.max(initial=1)))):
            m = np.flatnonzero((key[d:] == key[:-d]) & plain[d:])
            us.append(uid[m])
            vs.append(uid[m + d])
        pair = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], axis=1), axis=0) if us else np.empty((0, 2), np.int64)
        pair = pair[pair[:, 0] != pair[:, 1]]
        h = np.flatnonzero(hot)
        bucket = table.column("bucket")[0].as_py()
        u = np.concatenate([pair[:, 0], uid[h]])
        v = pa.array(np.concatenate([pair[:, 1], np.zeros(len(h), np.int64)]), mask=np.repeat([False, True], [len(pair), len(h)]))
        key = pa.array(np.concatenate([np.zeros(len(pair), np.int64), (bucket << 32) + key[h].astype(np.int64)]))
        return pa.table({"u": pa.array(u), "v": v, "key": key})

    return run


def _centres(hot: DataFrame) -> DataFrame:
    """(c, u): members u of large groups, each with the centres c of its groups; a centre is the member that lies in most of them.

    What copies were made from lies in more of their groups than any copy.
    """
    held = hot.join(hot.groupBy("u").agg(F.count("key").alias("w")), "u")
    chosen = held.groupBy("key").agg(F.max(F.struct("w", "u")).alias("p"))
    return hot.join(chosen, "key").select(F.col("p.u").alias("c"), "u").distinct()


DIFFERENCE = "c binary, s binary, n int, nc int, w int, linked boolean, d array<long>"


def _differ(num: int, den: int):
    """Rows (c, s, set_c, set_s) to the shingles in which s differs from its centre c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column("set_c"), batch.column("set_s"), strict=True):
                c, s = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                d = np.setxor1d(c, s, assume_unique=True).view(np.int64)
                out.append((len(s), len(c), len(d), len(d) * (den + num) <= (len(s) + len(c)) * (den - num), d))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("s"), *(pa.array(x, t) for x, t in zip(cols, kinds, strict=True))], [x.split()[0] for x in DIFFERENCE.split(", ")])

    return run


def _differences(groups: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Differences of members from their centres. A centre's set is dealt once for every SALTED members."""
    parts = groups.groupBy("c").agg(F.ceil(F.count("*") / SALTED).cast("long").alias("parts"))
    members = groups.where("c <> s").join(parts, "c").withColumn("salt", F.pmod(F.xxhash64("s"), F.col("parts"))).drop("parts")
    members = members.join(sets.select(F.col("sid").alias("s"), F.col("shingles").alias("set_s")), "s")
    centres = parts.join(sets.select(F.col("sid").alias("c"), F.col("shingles").alias("set_c")), "c").select("c", "set_c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"))
    return members.join(centres, ["c", "salt"]).select("c", "s", "set_c", "set_s").mapInArrow(tidy(_differ(num, den)), DIFFERENCE)


def _half(k: int):
    """sid, and 32 bits of those shingles of each text whose last bit is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = of_process(WordHashes, 0, MOST_WORDS)
        for batch in batches:
            sets = [s for s in (shingles(t.lower().split(), hashes, k) for t in texts_of(batch)) if len(s)]
            half = [(s[s & U(1) == 0] >> U(32)).astype(np.uint32).view(np.int32) for s in sets]
            sid = pa.array([set_id(s) for s in sets], pa.binary()).take(pa.array(np.repeat(np.arange(len(sets)), [len(h) for h in half]), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*half, np.empty(0, np.int32)]), pa.int32()), sid], ["x", "sid"])

    return run


def _lonely(docs: DataFrame, rows: DataFrame, members: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of ``members`` (sid) that can't link with any other: more than n * (1 - t) of their shingles are no other member's.

    Half of the shingles are counted, by 32 bits; equal bits make a shingle seem shared, so none is lost. Sets that have
    but a passage in common end here, before any set travels whole.
    """
    texts, owners = _texts_of(docs, rows, members)
    halves = texts.mapInArrow(tidy(_half(k)), "x int, sid binary").join(small(owners.select("sid")), "sid", "left_semi")
    alone = halves.groupBy("x").agg(F.min("sid").alias("sid"), F.max("sid").alias("last")).where("sid = last").select("sid")
    counts = alone.groupBy("sid").agg(F.count("*").alias("m"))
    sizes = rows.where("kind = 'set'").join(small(owners.select("sid")), "sid", "left_semi").select("sid", "n").distinct()
    return sizes.join(counts, "sid").where(f"{den} * m > {den - num} * n").select("sid")


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a group's differences by slot, on a scale of one byte: only their order matters."""
    for batch in batches:
        out = []
        for l in batch.column("l").to_pylist():
            m = np.zeros(SLOTS)
            m[[e["slot"] for e in l]] = [e["m"] for e in l]
            out.append(np.minimum(255, 12 * np.log2(m + 1)).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(out, pa.binary())], ["g", "levels"])


PLACED = "g long, x long, id long, n int, w int, i int, linked boolean, early boolean"


def _place(num: int, den: int):
    """The shingles of each difference that can decide, with their places."""
    plus, minus = den + num, den - num

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, PLACED_ROWS) for whole in batches for at in range(0, len(whole), PLACED_ROWS)):
            cols = [[np.empty(0, np.int64)] for _ in range(8)]
            for r in range(len(batch)):
                g, id_, n, nc, w, linked, levels, d = (c[r] for c in batch.columns)
                n, w, x = n.as_py(), w.as_py(), d.values.to_numpy()
                order = np.lexsort((x, np.frombuffer(levels.as_py(), np.uint8)[x & (SLOTS - 1)]))
                i = np.arange(min(w, n * minus // num + 1))  # no partner of a set of n differs from it in more than n * minus / num
                early = 2 * plus * i < plus * w + minus * (n - nc.as_py())
                i = i[early] if linked.as_py() else i
                for col, v in zip(cols, (g.as_py(), x[order[i]], id_.as_py(), n, w, i + 1, linked.as_py(), early[: len(i)]), strict=True):
                    col.append(v if isinstance(v, np.ndarray) else np.full(len(i), v))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]
            made = [pa.array(np.concatenate(c).astype(k.to_pandas_dtype()), k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(made, [x.split()[0] for x in PLACED.split(", ")])

    return run


def _meetings(differences: DataFrame, num: int, den: int) -> DataFrame:
    """(sid_a, sid_b): pairs of members of one group, the first not linked with the centre, whose differences can share enough for a link.

    Place i of a shingle in a difference counts from the one that fewest members have (by slots of a hash: any order that the
    whole group keeps to is right). If x is the first that A and B share, at places i and j, they share at most min(|DA| - i, |DB| - j) + 1.
    """
    plus, minus = den + num, den - num
    some = small(stage(differences.where("not linked").select("g").distinct(), "open"))
    those = differences.join(some, "g", "left_semi")
    slots = those.select("g", F.explode("d").alias("x")).groupBy("g", F.col("x").bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("slot")).agg(F.count("*").alias("m"))
    levels = slots.groupBy("g").agg(F.collect_list(F.struct("slot", "m")).alias("l")).mapInArrow(tidy(_levels), "g long, levels binary")
    levels = small(stage(levels, "levels"), MOST_LEVELS)
    placed = those.select("g", "id", "n", "nc", "w", "linked", "d").join(levels, "g").select("g", "id", "n", "nc", "w", "linked", "levels", "d")
    placed = stage(placed.mapInArrow(tidy(_place(num, den)), PLACED), "placed")
    a = placed.where("not linked").select("g", "x", *[F.col(k).alias(f"{k}_a") for k in ("id", "n", "w", "i", "early")])
    b = placed.where("early").select("g", "x", *[F.col(k).alias(f"{k}_b") for k in ("id", "n", "w", "i", "linked")])
    can = f"""(linked_b or early_a and id_a < id_b) and {den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b)
        and {plus} * (w_a + w_b) - {minus} * (n_a + n_b) <= 2 * {plus} * (least(w_a - i_a, w_b - i_b) + 1)"""
    met = stage(a.join(b, ["g", "x"]).where(can).select("id_a", "id_b").distinct(), "met")
    name = differences.select("id", "s")
    met = met.join(name.withColumnsRenamed({"id": "id_a", "s": "s_a"}), "id_a").join(name.withColumnsRenamed({"id": "id_b", "s": "s_b"}), "id_b")
    return met.where("s_a <> s_b").select(F.least("s_a", "s_b").alias("sid_a"), F.greatest("s_a", "s_b").alias("sid_b")).distinct()


def _near(num: int, den: int):
    """Keep pairs whose sizes and parity bits allow a link: |A xor B| <= (|A| + |B|)(den - num)/(den + num)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            a, b = batch.column("bits_a"), batch.column("bits_b")
            ok = [hamming(a[i].as_py(), b[i].as_py()) * (den + num) <= int(n[i] + m[i]) * (den - num) for i in range(len(n))]
            yield batch.select(["sid_a", "sid_b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, a, b = [], batch.column("set_a"), batch.column("set_b")
            for i in range(len(batch)):
                x, y = np.frombuffer(a[i].as_py(), "<u8"), np.frombuffer(b[i].as_py(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["sid_a", "sid_b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = of_process(WordHashes, 0, MOST_WORDS)
        for batch in batches:
            sets = [shingles(t.lower().split(), hashes, k) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) if len(s) else None for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["sid", "shingles"])

    return run


def _shingle_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = of_process(WordHashes, 0, MOST_WORDS)
        for batch in batches:
            sets = [shingles(t.lower().split(), hashes, k) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.empty(0, U)]).astype(U).view(np.int64))], ["s"])

    return run


def frequent_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Sorted hashes of shingles common in a sample of the documents; at most MOST_FREQUENT, a megabyte."""
    sampled = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    counts = sampled.mapInArrow(tidy(_shingle_rows(k)), "s long").groupBy("s").count().where(F.col("count") >= FREQUENT)
    top = counts.orderBy(F.desc("count"), "s").limit(MOST_FREQUENT).select("s").collect()
    return np.sort(np.array([r.s for r in top], np.int64).view(U))


def _key_of(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of uids to pairs of different sets that sizes and parity bits allow."""
    left = sets.select(F.col("uid").alias("u"), F.col("sid").alias("sid_a"), F.col("n").alias("n_a"), F.col("a").alias("bits_a"))
    right = sets.select(F.col("uid").alias("v"), F.col("sid").alias("sid_b"), F.col("n").alias("n_b"), F.col("a").alias("bits_b"))
    sized = pairs.join(left.drop("bits_a"), "u").join(right.drop("bits_b"), "v").where(f"sid_a <> sid_b and {den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b)")
    sized = sized.select("u", "v", "n_a", "n_b")
    full = sized.join(left.select("u", "sid_a", "bits_a"), "u").join(right.select("v", "sid_b", "bits_b"), "v")
    near = full.mapInArrow(tidy(_near(num, den)), "sid_a binary, sid_b binary")
    return near.select(F.least("sid_a", "sid_b").alias("sid_a"), F.greatest("sid_a", "sid_b").alias("sid_b")).distinct()


def _texts_of(docs: DataFrame, rows: DataFrame, needed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts in which all sets ``needed`` (sid) occur, and one (doc_id, sid) for each. Where doc_ids repeat there are other texts besides."""
    owners = rows.where("kind = 'doc'").join(needed, "sid").groupBy("sid").agg(F.min_by("doc_id", "uid").alias("doc_id"))
    owners = stage(owners.select("doc_id", "sid"), "owners")
    ids = owners.select(F.col("doc_id").alias("wanted")).distinct()
    return docs.select("doc_id", "text").join(small(ids), F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi"), owners


def _sets_of(docs: DataFrame, rows: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """sid, shingles of the sets ``needed`` (sid), by the text of one document each."""
    texts, owners = _texts_of(docs, rows, needed)
    sets = texts.mapInArrow(tidy(_sets(k)), "sid binary, shingles binary").where("sid is not null").join(small(owners.select("sid")), "sid", "left_semi")
    return stage(sets.dropDuplicates(["sid"]), "sets")


def _verified(near: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (sid_a, sid_b) that link, by exact intersection."""
    full = near.join(sets.select(F.col("sid").alias("sid_a"), F.col("shingles").alias("set_a")), "sid_a").join(sets.select(F.col("sid").alias("sid_b"), F.col("shingles").alias("set_b")), "sid_b")
    return full.mapInArrow(tidy(_verify(num, den)), "sid_a binary, sid_b binary")


def _labelled(docs: DataFrame, num: int, den: int, shingle: int, group_limit: int, buckets: int | None) -> tuple[DataFrame, DataFrame]:
    """The written rows of documents and sets, and (node, label): of each set that links with another the least of its component."""
    spark = docs.sparkSession
    if buckets is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    path = shared_dir(spark, "ngram-join")
    rows = write(docs.mapInArrow(tidy(_sketch(shingle, frequent_shingles(docs, shingle), buckets)), ROWS), f"{path}/rows", ["kind"])
    keyed = rows.where("kind = 'key'").select("bucket", "base", "a", "b")
    found = write(keyed.groupBy("bucket").applyInArrow(_pairs(group_limit), "u long, v long, key long"), f"{path}/pairs")
    sets = rows.where("kind = 'set'").select("uid", "sid", "n", "a")
    near = stage(_key_of(found.where("key = 0").select("u", "v").distinct(), sets, num, den), "near")
    named = sets.select("uid", "sid")
    groups = _centres(found.where("v is null").select("key", "u")).join(named.withColumnRenamed("uid", "u"), "u").withColumnRenamed("sid", "s")
    groups = groups.select("s", F.col("c").alias("uid")).join(named, "uid").select(F.col("sid").alias("c"), "s").distinct()
    groups = stage(groups, "groups")
    hot = not groups.isEmpty()
    if hot:
        lonely = _lonely(docs, rows, groups.select(F.col("s").alias("sid")).distinct(), shingle, num, den)
        groups = groups.join(lonely.withColumnRenamed("sid", "s"), "s", "left_anti")
        groups = stage(groups.join(groups.where("c <> s").select("c").distinct(), "c", "left_semi"), "groups")
    needed = near.select(F.col("sid_a").alias("sid")).unionByName(near.select(F.col("sid_b").alias("sid")))
    needed = needed.unionByName(groups.select(F.col("s").alias("sid"))).unionByName(groups.select(F.col("c").alias("sid"))).distinct()
    texts = _sets_of(docs, rows, needed, shingle)
    links = _verified(near, texts, num, den)
    if hot:
        # groups by hash (groups that fall together only add candidates), members by number
        differences = _differences(groups, texts, num, den).withColumns({"g": F.xxhash64("c"), "id": F.monotonically_increasing_id()})
        differences = stage(differences, "differences")
        met = stage(_meetings(differences, num, den).join(near, ["sid_a", "sid_b"], "left_anti"), "met")
        star = differences.where("linked").select(F.least("c", "s").alias("sid_a"), F.greatest("c", "s").alias("sid_b"))
        links = links.unionByName(star).unionByName(_verified(met, texts, num, den))
    return rows, stage(components(links.select(F.col("sid_a").alias("a"), F.col("sid_b").alias("b"))), "labels")


def near_duplicates(docs: DataFrame, num: int = 75, den: int = 100, shingle: int = SHINGLE, group_limit: int = GROUP_LIMIT, buckets: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``; two link when den * |A and B| >= num * |A or B|. num/den is 3/4 or more.

    ``buckets``: how many tasks the sketch words are dealt to; by default it follows from the bytes of all texts.
    """
    if 4 * num < 3 * den:
        raise ValueError("sketch words are chosen for similarities of 0.75 or more")
    with small_batches(docs.sparkSession):
        rows, label = _labelled(docs.select("doc_id", "text"), num, den, shingle, group_limit, buckets)
    per_doc = rows.where("kind = 'doc'").select("doc_id", "sid", F.col("n").alias("n_shingles"))
    per_set = per_doc.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("first"))
    per_set = per_set.join(label.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    least = per_set.groupBy("label").agg(F.min("first").alias("component_id"))
    named = per_set.join(least, "label").select("sid", "component_id")
    with_set = per_doc.where("sid is not null").join(named, "sid").select("doc_id", "n_shingles", "component_id")
    return with_set.unionByName(per_doc.where("sid is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
