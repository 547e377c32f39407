"""Byte-level BPE encoding and decoding in numpy.

All distinct new pieces of a batch of texts are merged together: their symbols lie in
one flat array, each round finds the ranks of all adjacent pairs by binary search over
the sorted pair keys, takes in every piece the lowest rank, and merges its occurrences.
The vocabulary and merges come from a tokenizers JSON file; nothing is trained here.

Edge cases: null and empty texts give no ids and decode to the empty text; strings of
special tokens in a text become their ids; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Recent, of_process

# The split pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(2**62)
SLICE = 1000


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteBPE:
    def __init__(self, path: str, bound: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.specials.values()]) + 1
        self.of_byte = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        back = {c: b for b, c in letters.items()}
        self.bytes_of = [b""] * self.size
        for token, i in [*vocab.items(), *self.specials.items()]:
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.result = merged
        self.split = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.pieces, self.chunks = Recent(bound), Recent(bound)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each non-empty piece."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbols = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lens)
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(pieces)
        alive = np.arange(len(pieces))  # piece behind each owner number
        while len(symbols):
            same = owner[:-1] == owner[1:]
            rank = np.full(len(symbols), NONE)
            rank[:-1][same] = self.rank_of(symbols[:-1][same], symbols[1:][same])
            starts = np.flatnonzero(np.r_[True, ~same])
            best = np.minimum.reduceat(rank, starts)
            if (done := best == NONE).any():
                ends = np.r_[starts[1:], len(symbols)]
                for k in np.flatnonzero(done):
                    out[alive[k]] = symbols[starts[k] : ends[k]]
                keep = np.repeat(~done, ends - starts)
                symbols, rank = symbols[keep], rank[keep]
                alive, best = alive[~done], best[~done]
                owner = np.repeat(np.arange(len(alive)), (ends - starts)[~done])
                if not len(symbols):
                    break
            hit = rank == best[owner]
            # of overlapping occurrences (aaa) the left one merges: keep those at even places of a run
            at = np.flatnonzero(hit)
            first = np.r_[True, np.diff(at) != 1]
            run = at[first][np.cumsum(first) - 1]
            at = at[(at - run) % 2 == 0]
            symbols[at] = self.result[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out

    def learn(self, pieces: set[str]) -> None:
        new = self.pieces.lacking(pieces)
        new.sort(key=len)
        at = 0
        while at < len(new):
            end, total = at, 0
            while end < len(new) and (end == at or total < 2_000_000):  # bounds the flat array
                total += len(new[end])
                end += 1
            for piece, ids in zip(new[at:end], self.merge([p.encode() for p in new[at:end]]), strict=True):
                self.pieces[piece] = ids.astype("<u4").tobytes()
            at = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        plans = [self._chunks(t) for t in texts]
        new = self.chunks.lacking(set(chain.from_iterable(plans)))
        cut = {c: self.split.findall(c) for c in new if c not in self.specials}
        self.learn(set(chain.from_iterable(cut.values())))
        for c, ps in cut.items():
            self.chunks[c] = b"".join(map(self.pieces.__getitem__, ps))
        for c in self.specials.keys() & set(new):
            self.chunks[c] = np.array([self.specials[c]], "<u4").tobytes()
        return [b"".join(map(self.chunks.__getitem__, plan)) for plan in plans]

    def _chunks(self, text: str) -> list[str]:
        """Parts that are split independently: special tokens; else cut before a space between two characters that aren't white space."""
        if self.special and "<|" in text and self.special.search(text):
            return [c for part in self.special.split(text) if part for c in ([part] if part in self.specials else self._chunks(part))]
        parts = text.split(" ")
        if "" not in parts and not any(p[0].isspace() or p[-1].isspace() for p in parts):
            return [parts[0], *[" " + p for p in parts[1:]]]
        out = parts[:1]
        for p in parts[1:]:
            if p and out[-1] and not p[0].isspace() and not out[-1][-1].isspace():
                out.append(" " + p)
            else:
                out[-1] += " " + p
        return [c for c in out if c]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _run(path: str, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = of_process(ByteBPE, path)
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, len(whole), SLICE)):
            encoded = coder.encode([t or "" for t in batch.column(1).to_pylist()])
            texts = [coder.decode(e) for e in encoded]
            cols = [batch.column(0), pa.array([len(e) // 4 for e in encoded], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in encoded]), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if full:
                cols += [pa.array([np.frombuffer(e, "<u4").astype(np.int64) for e in encoded], pa.list_(pa.int64())), pa.array(texts)]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, tokenizer: str, full: bool = False) -> DataFrame:
    """Encode and decode every text of ``docs`` (doc_id, text); ``full`` adds the ids and the decoded text. No shuffle."""
    schema = DIGESTS + (", ids array<long>, decoded string" if full else "")
    return docs.select("doc_id", "text").mapInArrow(_run(tokenizer, full), schema)
