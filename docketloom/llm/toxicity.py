"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a word: a hashed word embedding, and the mean and the maximum of embeddings of its
hashed byte n-grams. A forward and a backward GRU run over pieces of ``CORE`` words with ``CONTEXT`` words
around them, so that every word of a text has one state. Attention pools the states of every run of ``WIDTH``
consecutive words (all overlapping windows, one starting at each word), a logistic unit scores the window; a document's score is the
highest of its windows, so texts of any length are scored whole. As attention weights and the unit's input
are one number a word each, windows cost sliding sums only.

Training sees a bounded sample of labelled rows and runs in one task of an executor: at most ``most_toxic`` and
``most_clean`` rows in the order of a hash of their doc_ids, and ``most_bytes`` of text together. If they have more, an equal
allowance for each text is found that keeps to the bound, and a longer text gives the consecutive pieces that a hash chooses. The first
coordinate of an embedding is how much more a word or n-gram counts in toxic than in clean documents (in standard
deviations), the more the more often it comes back in one, so that a stem with ever new endings shows, also in a language with few documents; while training, a document's inputs take it from the half of the sample that the document isn't in. All
other coordinates, of words and of n-grams, are learned with the network. Labels are of documents, so
each epoch trains on the windows that the current network scores highest in each document. At the end a logistic
fit of the sample's labels to the highest logits of its documents turns a document's logit into its score.
The language, source and doc_id of a row are never inputs.

Edge cases: null and empty texts are one window of nothing and get a score; labels that are
null, or whose doc_id is null, teach nothing; with labels of one kind only or none, scores are
that kind's rate, 0.1 at first; rows with equal or null doc_ids are scored one by one.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliding, stage
from .ngram_join import texts_of

WIDTH, CORE, CONTEXT = 32, 48, 12
HIDDEN, ATTENTION, EMBED = 8, 8, 4
INPUTS = 3 * EMBED
BUCKETS = 1 << 18
MOST_TOXIC, MOST_CLEAN, MOST_BYTES = 900, 5400, 64 << 20
PIECE = 4096
CLEAN_A_EPOCH = 1800
THRESHOLD = 0.3
OFTEN = 4
BATCH, RATE, LEAST_BETWEEN = 64, 0.05, 60
# Letters to lower case, all other ASCII characters but digits to spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
F32 = np.float32


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def gram_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 4- and 5-byte grams of all words (with marks at both ends), and where each word's begin."""
    flat = np.frombuffer(b"^" + b"$$$$^".join(words) + b"$$$$$", np.uint8).astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.r_[0, np.cumsum(lens + 5)][:-1]
    four = np.zeros(len(flat), np.uint64)
    for j in range(4):
        four[: len(flat) - j] = four[: len(flat) - j] * np.uint64(257) + flat[j:]
    five = four.copy()
    five[:-4] = five[:-4] * np.uint64(263) + flat[4:] + np.uint64(1 << 40)
    counts = lens + 1  # grams from the mark before the word to its last byte
    begin = np.r_[0, np.cumsum(counts)][:-1]
    at = np.arange(int(counts.sum())) - np.repeat(begin - starts, counts)
    both = np.stack([four[at], five[at]], axis=1).ravel()
    return _bucket(both), begin * 2


def _bucket(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) & np.uint64(BUCKETS - 1)).astype(np.int64)


def word_buckets(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & (BUCKETS - 1)


def number(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words; the numbers (from 1) of the words of all texts; where each text begins in them; its words.

    Every text has ``WIDTH`` places at least; places without a word hold 0. ``CONTEXT`` zeros stand before all texts and between them,
    so many more at the end that a piece may begin anywhere.
    """
    known: dict[bytes, int] = {}
    gap, parts, begin, sizes, total = np.zeros(CONTEXT, np.int32), [], [], [], 0
    for t in texts:
        ids = np.array([known.setdefault(w, len(known) + 1) for w in words_of(t)], np.int32)
        parts += [gap, ids, np.zeros(max(0, WIDTH - len(ids)), np.int32)]
        begin.append(total + CONTEXT)
        sizes.append(len(ids))
        total += CONTEXT + max(WIDTH, len(ids))
    parts.append(np.zeros(CORE + 2 * CONTEXT + WIDTH, np.int32))
    return list(known), np.concatenate(parts), np.array(begin, np.int64), np.array(sizes, np.int64)


def pieces(begin: np.ndarray, sizes: np.ndarray, step: int = CORE) -> tuple[np.ndarray, np.ndarray]:
    """Where the cores of all texts begin, and how many words they have; an empty text has one core of one place."""
    count = np.maximum(1, -(-sizes // step))
    inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(begin, count) + inner * step, np.minimum(step, np.maximum(1, np.repeat(sizes, count) - inner * step))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return F32(1) / (F32(1) + np.exp(-x))


class Network:
    """Parameters: embeddings ``word`` and ``gram``, GRUs in both directions, attention and output."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(F32)
        self.word, self.gram = np.zeros((BUCKETS, EMBED), F32), np.zeros((BUCKETS, EMBED), F32)
        self.p = {"wo": init(2 * HIDDEN), "bo": np.array([-2.0], F32), "wa": init(2 * HIDDEN, ATTENTION), "ba": np.zeros(ATTENTION, F32), "va": init(ATTENTION)}
        for d in "fb":
            self.p |= {f"x{d}": init(INPUTS, 3 * HIDDEN), f"h{d}": init(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, F32)}
        self.constant: float | None = None
        self.scale = (1.0, 0.0)

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """One row a word, after a row of zeros."""
        out = np.zeros((len(words) + 1, INPUTS), F32)
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            buckets, begin = gram_buckets(part)
            rows, to = self.gram[buckets], slice(at + 1, at + 1 + len(part))
            counts = np.diff(np.r_[begin, len(buckets)])[:, None]
            out[to, :EMBED] = self.word[word_buckets(part)]
            out[to, EMBED : 2 * EMBED] = np.add.reduceat(rows, begin) / counts
            out[to, 2 * EMBED :] = np.maximum.reduceat(rows, begin)
        return out

    def states(self, table: np.ndarray, seqs: np.ndarray, saved: dict | None = None) -> np.ndarray:
        """States (time, sequence, both directions) over sequences of word numbers. ``table``: inputs by number. Places with 0 change nothing, but the first after the context."""
        p, (n, T), H = self.p, seqs.shape, HIDDEN
        mask = seqs > 0
        mask[:, CONTEXT] = True
        states = np.zeros((T, n, 2 * H), F32)
        whole = mask.all(axis=0)
        for d in "fb":
            given = table @ p[f"x{d}"] + p[f"c{d}"]
            wh, h = p[f"h{d}"], np.zeros((n, H), F32)
            for t in range(T) if d == "f" else range(T - 1, -1, -1):
                a, g = given[seqs[:, t]], h @ wh
                zr = sigmoid(a[:, : 2 * H] + g[:, : 2 * H])
                z, r = zr[:, :H], zr[:, H:]
                c = np.tanh(a[:, 2 * H :] + r * g[:, 2 * H :])
                new = c + z * (h - c)
                if not whole[t]:
                    new = np.where(mask[:, t][:, None], new, h)
                if saved is not None:
                    saved[d, t] = (h, z, r, c, g[:, 2 * H :])
                h = new
                states[t, :, (0 if d == "f" else H) : (H if d == "f" else 2 * H)] = h
        return states

    def run(self, table: np.ndarray, seqs: np.ndarray, keep: bool = False):
        """Logits of windows, each given with its context before and after; ``keep`` also returns what backward() needs."""
        p, saved = self.p, {} if keep else None
        states = self.states(table, seqs, saved)[CONTEXT : CONTEXT + WIDTH]
        mask = seqs[:, CONTEXT : CONTEXT + WIDTH].T > 0
        mask[0] = True
        u = np.tanh(states @ p["wa"] + p["ba"])
        e = np.where(mask, u @ p["va"], F32(-1e9))
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", w, states)
        logit = pooled @ p["wo"] + p["bo"][0]
        return (logit, (states, u, w, pooled, saved)) if keep else logit

    def backward(self, table: np.ndarray, seqs: np.ndarray, kept, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters and of the input rows."""
        p, H, (n, T) = self.p, HIDDEN, seqs.shape
        states, u, w, pooled, saved = kept
        mask = seqs > 0
        mask[:, CONTEXT] = True
        g = {"wo": pooled.T @ dlogit, "bo": np.array([dlogit.sum()], F32)}
        dpool = dlogit[:, None] * p["wo"]
        dw = np.einsum("nh,tnh->tn", dpool, states)
        de = w * (dw - (w * dw).sum(axis=0))
        g["va"] = np.einsum("tn,tna->a", de, u)
        du = de[:, :, None] * p["va"] * (1 - u * u)
        g["wa"], g["ba"] = np.einsum("tnh,tna->ha", states, du), du.sum(axis=(0, 1))
        ds = np.zeros((T, n, 2 * H), F32)
        ds[CONTEXT : CONTEXT + WIDTH] = w[:, :, None] * dpool + du @ p["wa"].T
        dtable = np.zeros_like(table)
        for d, cut in (("f", slice(0, H)), ("b", slice(H, 2 * H))):
            wh, dh, da_all = p[f"h{d}"], np.zeros((n, H), F32), np.zeros((len(table), 3 * H), F32)
            g[f"h{d}"] = np.zeros_like(wh)
            for t in range(T - 1, -1, -1) if d == "f" else range(T):
                h, z, r, c, gn = saved[d, t]
                m = mask[:, t][:, None]
                dnew = dh + ds[t, :, cut]
                dc = dnew * (1 - z) * m
                dz = dnew * (h - c) * m * z * (1 - z)
                dn = dc * (1 - c * c)
                dr = dn * gn * r * (1 - r)
                da = np.concatenate([dz, dr, dn], axis=1)
                dg = np.concatenate([dz, dr, dn * r], axis=1)
                g[f"h{d}"] += h.T @ dg
                np.add.at(da_all, seqs[:, t], da)
                dh = np.where(m, dnew * z + dg @ wh.T, dnew)
            g[f"c{d}"] = da_all.sum(axis=0)  # also of places without a word that count
            da_all[0], g[f"x{d}"] = 0, table.T @ da_all
            dtable += da_all @ p[f"x{d}"].T
        return g, dtable

    def logits(self, table: np.ndarray, ids: np.ndarray, begin: np.ndarray, sizes: np.ndarray, step: int = 2048) -> np.ndarray:
        """By place in ``ids``: the logit of the window that begins there; -inf where none does. Texts come from number()."""
        p, (at, length) = self.p, pieces(begin, sizes)
        weight, value = np.zeros(len(ids), F32), np.zeros(len(ids), F32)
        inside = np.arange(CORE)
        for i in range(0, len(at), step):
            a, n = at[i : i + step], length[i : i + step]
            # words of the texts before and after must not be seen: gaps of CONTEXT places part them
            seqs = ids[a[:, None] + np.arange(-CONTEXT, CORE + CONTEXT)]
            last = n < CORE
            seqs[last] = np.where(np.arange(-CONTEXT, CORE + CONTEXT) < n[last][:, None], seqs[last], 0)
            s = self.states(table, seqs)[CONTEXT : CONTEXT + CORE]
            real = inside[:, None] < n
            to = (a + inside[:, None])[real]
            e = np.exp(np.tanh(s @ p["wa"] + p["ba"]) @ p["va"])
            weight[to] = e[real]
            value[to] = (e * (s @ p["wo"]))[real]
        total = sliding(weight.astype(np.float64), WIDTH, np.add)
        out = np.full(len(ids), -np.inf)
        count = np.maximum(1, sizes - WIDTH + 1)
        starts = np.repeat(begin, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        out[starts] = sliding(value.astype(np.float64), WIDTH, np.add)[starts] / total[starts] + p["bo"][0]
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        words, ids, begin, sizes = number(texts)
        best = np.maximum.reduceat(self.logits(self.inputs(words), ids, begin, sizes), begin)
        return 1 / (1 + np.exp(-(self.scale[0] * best + self.scale[1])))

    def packed(self) -> tuple:
        """The parameters, and only those embeddings that training touched."""
        at = [np.flatnonzero(e.any(axis=1)) for e in (self.word, self.gram)]
        return self.p, at, [self.word[at[0]], self.gram[at[1]]], self.constant, self.scale

    @staticmethod
    def unpacked(packed: tuple) -> Network:
        net = Network()
        net.p, at, rows, net.constant, net.scale = packed
        net.word[at[0]], net.gram[at[1]] = rows
        return net


def recurring(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a document, and how much each counts: a quarter for each time up to ``OFTEN``. A stem that comes back in ever new words weighs more than one that occurs."""
    at, n = np.unique(buckets, return_counts=True)
    return at.astype(np.int32), (np.minimum(n, OFTEN) / OFTEN).astype(F32)


def spread(t: np.ndarray, all_: np.ndarray, rate: float) -> np.ndarray:
    """By bucket: how much more it counts in toxic documents (``t`` of ``all_``) than their share would have it, in standard deviations, scaled and clipped."""
    expected = all_ * rate
    z = (t - expected) / np.sqrt(expected + 1)
    return np.where(all_ > 0, np.clip(z, -3, 8) / 4, 0).astype(F32)


def calibrated(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Slope and shift of a logistic fit of labels to logits, by Newton's method from (1, 0)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = q * (1 - q) + 1e-9
        g = np.array([((q - y) * x).sum() + ridge * (a - 1), (q - y).sum()])
        step = np.linalg.solve([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum()]], g)
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def train(texts: list[bytes], toxic: np.ndarray, epochs: int = 7, least_steps: int = 600, seed: int = 7) -> Network:
    net = Network(seed)
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        net.constant = float(toxic.mean()) if len(toxic) else 0.1
        return net
    rng = np.random.default_rng(seed)
    fold = np.arange(len(texts)) % 2
    fold[toxic] = np.arange(toxic.sum()) % 2
    counts = np.zeros((2, 2, 2, BUCKETS))  # of words and n-grams, by fold: in toxic documents, in all
    for text, k, y in zip(texts, fold, toxic, strict=True):  # one document's words at a time
        own = words_of(text)
        for kind, buckets in enumerate((word_buckets(own), gram_buckets(own)[0] if own else np.empty(0, np.int64))):
            at, n = recurring(buckets)
            counts[kind, k, 1, at] += n
            if y:
                counts[kind, k, 0, at] += n
    stats = []  # for each fold from the counts of the other, so that no document meets its own label in its inputs
    for kind, table in enumerate((net.word, net.gram)):
        touched = np.flatnonzero(counts[kind, :, 1].any(axis=0))
        table[touched, 1:] = rng.standard_normal((len(touched), EMBED - 1)).astype(F32) * F32(0.02)
        rate = [toxic[fold == k].mean() if (fold == k).any() else 0.0 for k in (0, 1)]
        stats.append([spread(*counts[kind, 1 - k], rate[1 - k]) for k in (0, 1)])
        stats[-1].append((stats[-1][0] + stats[-1][1]) / 2)
    words, ids, begin, sizes = number(texts)
    word_b, (gram_b, gram_at) = word_buckets(words), gram_buckets(words)
    gram_n = np.diff(np.r_[gram_at, len(gram_b)])
    # words of the second fold's documents have rows of their own
    ends = begin + np.maximum(sizes, 1)
    for a, b in zip(begin[fold == 1].tolist(), ends[fold == 1].tolist(), strict=True):
        ids[a:b] += np.where(ids[a:b] > 0, len(words), 0).astype(ids.dtype)

    def inputs(k: int) -> np.ndarray:
        net.word[:, 0], net.gram[:, 0] = stats[0][k], stats[1][k]
        return net.inputs(words)

    moments: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    steps, scored_at = 0, -LEAST_BETWEEN
    per_epoch = max(1, int(toxic.sum() + 3 * min(CLEAN_A_EPOCH, (~toxic).sum())) // BATCH)
    reach = np.arange(-CONTEXT, WIDTH + CONTEXT)
    for epoch in range(max(epochs, -(-least_steps // per_epoch))):
        if epoch < 2 or steps - scored_at >= LEAST_BETWEEN:  # few windows make short epochs, which do not score all texts anew
            table, scored_at = np.concatenate([inputs(0), inputs(1)[1:]]), steps
            if epoch == 0:  # the untrained network knows nothing: choose by the embeddings' first coordinates
                score = np.full(len(ids), -np.inf)
                top = sliding((table[:, 0] + table[:, 2 * EMBED])[ids], WIDTH, np.maximum)
                score[: len(top)] = top
            else:
                score = net.logits(table, ids, begin, sizes)
        picked, label = [], []
        clean = set(rng.permutation(np.flatnonzero(~toxic))[:CLEAN_A_EPOCH].tolist())
        for i, (a, n, y) in enumerate(zip(begin.tolist(), np.maximum(1, sizes - WIDTH + 1).tolist(), toxic, strict=True)):
            if not y and i not in clean:
                continue
            own = score[a : a + n]
            best = a + int(own.argmax())
            picked.append(best)
            label.append(y)
            if not y and n > WIDTH:  # the best window that shares few words with the first, and any other
                far = np.where(abs(np.arange(a, a + n) - best) < WIDTH // 2, -np.inf, own)
                picked += [a + int(far.argmax()), int(rng.integers(a, a + n))]
                label += [False, False]
        picked, label = np.array(picked), np.array(label, F32)
        of_text = np.searchsorted(begin, picked, "right") - 1
        stop = begin[of_text] + sizes[of_text]
        for part in np.array_split(rng.permutation(len(picked)), max(1, len(picked) // BATCH)):
            at = picked[part][:, None] + reach
            w = np.where(at < np.maximum(stop[part], picked[part] + 1)[:, None], ids[at], 0)
            own, w = np.unique(np.r_[0, w.ravel()], return_inverse=True)  # only the rows that the batch needs
            w = w[1:].reshape(-1, len(reach))
            rows = table[own]
            logit, kept = net.run(rows, w, keep=True)
            g, drows = net.backward(rows, w, kept, ((sigmoid(logit) - label[part]) / len(part)).astype(F32))
            steps += 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for k, v in g.items():
                v = v * min(1.0, 5.0 / (norm + 1e-12)) + 1e-4 * net.p[k]
                m, s = moments.get(k, (np.zeros_like(v), np.zeros_like(v)))
                m, s = 0.9 * m + 0.1 * v, 0.999 * s + 0.001 * v * v
                moments[k] = m, s
                net.p[k] = (net.p[k] - 0.01 * (m / (1 - 0.9**steps)) / (np.sqrt(s / (1 - 0.999**steps)) + 1e-8)).astype(F32)
            if len(own) > 1:
                of = (own[1:] - 1) % len(words)
                np.subtract.at(net.word[:, 1:], word_b[of], F32(RATE) * drows[1:, 1:EMBED])
                learn_grams(net.gram, gram_b, gram_at[of], gram_n[of], F32(RATE) * drows[1:])
    table = np.concatenate([inputs(0), inputs(1)[1:]])
    net.scale = calibrated(np.maximum.reduceat(net.logits(table, ids, begin, sizes), begin), toxic)
    inputs(2)
    return net


def learn_grams(gram: np.ndarray, buckets: np.ndarray, begin: np.ndarray, counts: np.ndarray, step: np.ndarray) -> None:
    """Take ``step``, of the input rows of words, off the learned coordinates of their n-grams: through the mean, and of the greatest alone."""
    first = np.cumsum(counts) - counts
    at = buckets[np.repeat(begin - first, counts) + np.arange(int(counts.sum()))]
    rows = gram[at]
    share = np.repeat(step[:, EMBED + 1 : 2 * EMBED] / counts[:, None], counts, axis=0)
    greatest = rows[:, 1:] == np.repeat(np.maximum.reduceat(rows[:, 1:], first), counts, axis=0)
    np.subtract.at(gram[:, 1:], at, share + np.where(greatest, np.repeat(step[:, 2 * EMBED + 1 :], counts, axis=0), F32(0)))


def allowance(lengths: list[int], most: int) -> int:
    """The greatest bytes a text such that all texts, longer ones cut to it, have ``most`` bytes at most."""
    left = most
    for i, n in enumerate(sorted(lengths)):
        if n * (len(lengths) - i) > left:
            return max(1, left // (len(lengths) - i))
        left -= n
    return max(lengths, default=1)


def shortened(text: bytes, most: int) -> bytes:
    """A text of at most ``most`` bytes whole; of a longer one, pieces of PIECE bytes or less (cut at spaces) that a hash of them chooses, in their order."""
    if len(text) <= most:
        return text
    parts, at = [], 0
    while at < len(text):
        to = len(text) if len(text) - at <= PIECE else text.rfind(b" ", at, at + PIECE)
        to = to if to > at else min(len(text), at + PIECE)
        parts.append(text[at:to])
        at = to
    chosen, left = [], most
    for i in sorted(range(len(parts)), key=lambda i: (zlib.crc32(parts[i]), i)):
        if len(parts[i]) <= left:
            chosen.append(i)
            left -= len(parts[i])
    return b" ".join(parts[i] for i in sorted(chosen))


def _shorten(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shortened(t, most) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(texts, pa.binary())], ["doc_id", "toxic", "text"])

    return run


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The one training task: all rows in, the packed network out."""
    rows = [(zlib.crc32(str(d).encode()), d, t, y) for b in batches for d, t, y in zip(b.column("doc_id").to_pylist(), texts_of(b), b.column("toxic").to_pylist(), strict=True)]
    rows.sort()
    net = train([r[2] for r in rows], np.array([r[3] == 1 for r in rows], bool))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net.packed())], pa.binary())], ["model"])


def training_rows(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, toxic, text of a bounded sample of labelled rows that are not held out, in the order of a hash of their doc_ids."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(most_toxic).unionByName(known.where("toxic <> 1").orderBy(*order).limit(most_clean))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # repeated doc_ids could be many rows: the bound holds for rows
    texts = stage(texts.orderBy(*order, F.xxhash64("text")).limit(most_toxic + most_clean), "training-rows")
    lengths = [r[0] for r in texts.select(F.octet_length("text")).collect()]
    return texts.select("doc_id", "toxic", "text").mapInArrow(_shorten(allowance(lengths, most_bytes)), "doc_id long, toxic int, text binary")


def fit(docs: DataFrame, labels: DataFrame) -> tuple:
    """The packed network, trained in one task; its size is bounded by BUCKETS."""
    model = training_rows(docs, labels).repartition(1).mapInArrow(_train, "model binary")
    return pickle.loads(bytes(stage(model, "toxicity-model").first()["model"]))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.unpacked(model.value)
        for whole in batches:
            for at in range(0, len(whole), 2000):
                batch = whole.slice(at, 2000)
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(net.scores(texts_of(batch)), pa.float64())], ["row", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` as struct ``row`` and its ``score``. Scoring is one pass without a shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_score(model), f"row {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    scored = score(docs.select("doc_id", "text"), labels).select("row.doc_id", "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
