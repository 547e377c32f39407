"""SentencePiece encoding and decoding that keeps source offsets.

Normalisation walks the text by the longest prefixes that the model's compiled character map
(a double-array trie over UTF-8 with a pool of replacements) knows, and records for every normalised
character which source byte it came from. Pieces then merge by score, the leftmost of equal scores first, and the
ends of the pieces, looked up in that record, give every piece its original byte span; the prefix space that
isn't in the text spans nothing, and the bytes of an unknown character span nothing but for the last, which spans it.

Texts are cut where no piece of the vocabulary can reach across (before a space mark after another character, around a line
feed where no piece holds one), and equal cuts are encoded once: two generations of a bounded cache. If
the vocabulary could reach across, whole texts are merged. A model with pieces that the user defined, unused pieces or
another segmentation than BPE is refused.

Edge cases: null and empty texts have the begin and end ids only and decode to the empty text; texts are
encoded whole, in n log n of their longest cut; repeated rows and null doc_ids keep a row each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import string
import struct
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Recent, of_process

# Types of pieces, numbers of the model file's fields and the mark that stands for a space.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
SPACE = "▁"
SHORT = 24
SLICE = 1000


def fields(data: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """(number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        elif kind == 2:
            size = varint()
            yield number, data[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield number, struct.unpack("<f" if kind == 5 else "<d", data[at : at + size])[0]
            at += size


class CharacterMap:
    """The compiled character map: longest known prefix of some bytes, with its replacement."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.pool = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, str] | None:
        """(bytes consumed, replacement); a unit holds its label, the offset to its children and whether a value ends there."""
        units, found = self.units, None
        if not units:
            return None
        place = self._offset(units[0])
        for i in range(at, len(data)):
            place ^= data[i]
            if place >= len(units):
                break
            unit = units[place]
            if unit & 0x800000FF != data[i]:
                break
            place ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[place] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.pool[found[1] : self.pool.index(b"\0", found[1])].decode()

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)


class Pieces:
    """One model: normalisation with alignment, merges, ids and spans."""

    def __init__(self, path: str, bound: int = 400_000):
        with open(path, "rb") as f:
            parts = list(fields(f.read()))
        trainer = dict(x for n, v in parts if n == 2 for x in fields(v))
        norm = dict(x for n, v in parts if n == 3 for x in fields(v))
        pieces = [dict(fields(v)) for n, v in parts if n == 1]
        self.kinds = [p.get(3, NORMAL) for p in pieces]
        if trainer.get(3, 1) != 2 or set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE} or trainer.get(24, 0):
            raise ValueError("only BPE models without user-defined or unused pieces, with spaces as prefixes")
        self.texts = [p[1].decode() for p in pieces]
        self.bos, self.eos = self.texts.index(trainer.get(46, b"<s>").decode()), self.texts.index(trainer.get(47, b"</s>").decode())
        self.unknown = self.kinds.index(UNKNOWN)
        self.unknown_text = trainer.get(44, " ⁇ ".encode()).decode()
        self.map = CharacterMap(norm.get(2, b""))
        self.prefix, self.squeeze, self.escape = bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)) if k == NORMAL}
        self.scores = {t: pieces[i].get(2, 0.0) for t, i in self.ids.items()}
        self.byte_ids = [self.texts.index(f"<0x{b:02X}>") for b in range(256)] if trainer.get(35, 0) else None
        bytes_of = {i: b for b, i in enumerate(self.byte_ids or [])}
        self.surface = [bytes([bytes_of[i]]) if i in bytes_of else b"" if k == CONTROL else self.unknown_text.encode() if k == UNKNOWN else t.replace(SPACE, " ").encode() for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True))]
        self.cut = self._cutter()
        self.cuts = Recent(bound)

    def _cutter(self) -> re.Pattern | None:
        """Cuts between characters that no piece holds side by side: before a space mark that follows another character, around line feeds, and
        between a letter or digit and the marks that never follow one."""
        pairs = {p for t in self.ids for p in pairwise(t)}
        if any(b == SPACE != a for a, b in pairs):
            return None
        feed = "" if any("\n" in p for p in pairs) else r"\n"
        apart = "".join(re.escape(c) for c in string.punctuation if c != "_" and not any(b == c and a.isalnum() for a, b in pairs))
        other, joined, word = rf"(?:[^\w{SPACE}{feed}]|_)", rf"(?:[^\w{SPACE}{feed}{apart}]|_)", r"[^\W_]"
        words = rf"(?:{word}+(?:{joined}{other}*)?)"
        return re.compile(rf"{SPACE}+{other}*{words}*|{other}+{words}*|{words}+" + (r"|\n+" if feed else ""))

    # normalisation

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters, and for its end, the source byte where it begins."""
        if not self.map.units and not self.squeeze:
            return self._plain(text)
        return self._mapped(text.encode())

    def _plain(self, text: str) -> tuple[str, np.ndarray]:
        """No map and no spaces to drop: characters stay, spaces become marks."""
        if not text:
            return "", np.zeros(1, np.int64)
        data = text.encode()
        if len(data) == len(text):
            begins = np.arange(len(data) + 1)
        else:
            begins = np.flatnonzero((np.frombuffer(data + b"\0", np.uint8) & 0xC0) != 0x80)
        out = text.replace(" ", SPACE) if self.escape else text
        return (SPACE if self.escape else " ") * self.prefix + out, np.r_[[0] * self.prefix, begins]

    def _mapped(self, data: bytes) -> tuple[str, np.ndarray]:
        out, begins, at, mark = [], [], 0, SPACE if self.escape else " "
        prefix = lambda: self.map.longest(data, at) or self._one(data, at)
        while self.squeeze and at < len(data) and (first := prefix())[1] == " ":
            at += first[0]
        if self.prefix and at < len(data):
            out.append(mark)
            begins.append(at)
        spaced = self.squeeze  # whether a space here would follow another, or begin the text
        while at < len(data):
            size, new = prefix()
            begin, at = at, at + size
            if spaced:
                new = new.lstrip(" ")
            out.append(new.replace(" ", mark))
            begins += [begin] * len(new)
            spaced = self.squeeze and (new.endswith(" ") if new else spaced)
        text, end = "".join(out), at
        if self.squeeze:
            kept = text.rstrip(mark)
            end = begins[len(kept)] if len(kept) < len(text) else end
            text, begins = kept, begins[: len(kept)]
        return text, np.array([*begins, end], np.int64)

    @staticmethod
    def _one(data: bytes, at: int) -> tuple[int, str]:
        first = data[at]
        size = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
        return size, data[at : at + size].decode()

    # merges

    def merge(self, text: str) -> list[str]:
        """Pieces of one cut: the pair of the best score merges, the leftmost of equals, until none is known."""
        parts = list(text)
        if len(parts) > SHORT:
            return self._merge_long(parts)
        score, none = self.scores.get, -math.inf
        pairs = [score(a + b, none) for a, b in pairwise(parts)]
        while pairs and (best := max(pairs)) > none:
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i:
                pairs[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = score(parts[i] + parts[i + 1], none)
        return parts

    def _merge_long(self, parts: list) -> list[str]:
        """The same with a heap of pairs over a linked list."""
        scores, n = self.scores, len(parts)
        before, after, heap = list(range(-1, n - 1)), [*range(1, n), -1], []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0:
                both = parts[left] + parts[right]
                score = scores.get(both)
                if score is not None:
                    heapq.heappush(heap, (-score, left, right, len(both)))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, size = heapq.heappop(heap)
            if parts[left] is None or parts[right] is None or after[left] != right or len(parts[left]) + len(parts[right]) != size:
                continue
            parts[left] += parts[right]
            parts[right] = None
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [p for p in parts if p is not None]

    def _encode_cut(self, text: str) -> bytes:
        """Pairs of an id and how many characters it covers; all bytes of an unknown character but the last cover none."""
        out: list[int] = []
        for piece in self.merge(text):
            known = self.ids.get(piece)
            if known is not None:
                out += (known, len(piece))
            elif self.byte_ids:
                for b in piece.encode():
                    out += (self.byte_ids[b], 0)
                out[-1] = len(piece)
            else:
                out += (self.unknown, len(piece))
        return struct.pack(f"<{len(out)}I", *out)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids with begin and end ids, and [begin, end) of source bytes for each, of every text."""
        normal = [self.normalise(t) for t in texts]
        plans = [(self.cut.findall(t) if self.cut else [t]) if t else [] for t, _ in normal]
        for cut in self.cuts.lacking(set().union(*plans)):
            self.cuts[cut] = self._encode_cut(cut)
        out = []
        for plan, (_, begins) in zip(plans, normal, strict=True):
            found = np.frombuffer(b"".join(map(self.cuts.__getitem__, plan)), "<u4").reshape(-1, 2)
            ids, ends = found[:, 0], np.cumsum(found[:, 1], dtype=np.int64)
            if self.byte_ids is None and len(ids) > 1:  # unknown characters in a row are one piece, across cuts too
                stay = ~((ids == self.unknown) & np.r_[ids[1:] == self.unknown, False])
                ids, ends = ids[stay], ends[stay]
            bounds = np.zeros(len(ids) + 3, np.int64)  # the begin and end ids span nothing
            bounds[1:-1] = begins[np.concatenate([[0], ends])]
            bounds[0], bounds[-1] = bounds[1], bounds[-2]
            whole = np.empty(len(ids) + 2, "<u4")
            whole[0], whole[1:-1], whole[-1] = self.bos, ids, self.eos
            out.append((whole, np.column_stack([bounds[:-1], bounds[1:]])))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of any ids: control ids give nothing, bytes in a row are read as UTF-8, what isn't is replaced byte by byte."""
        kinds, rest = self.kinds, ids.tolist()
        lead = next((i for i, t in enumerate(rest) if kinds[t] != CONTROL), len(rest))
        data = list(map(self.surface.__getitem__, rest))
        if lead < len(rest) and (self.prefix or self.squeeze) and kinds[rest[lead]] == NORMAL and self.texts[rest[lead]].startswith(SPACE):
            data[lead] = data[lead][1:] if not self.squeeze else data[lead].lstrip(b" ")
        try:
            return b"".join(data).decode()
        except UnicodeDecodeError:
            return self._decode_broken(rest, data)

    def _decode_broken(self, ids: list[int], data: list[bytes]) -> str:
        out, at = [], 0
        while at < len(ids):
            end = at + 1
            if self.kinds[ids[at]] == BYTE:
                while end < len(ids) and self.kinds[ids[end]] == BYTE:
                    end += 1
            out.append(replaced(b"".join(data[at:end])))
            at = end
        return "".join(out)


def replaced(data: bytes) -> str:
    """UTF-8, with a replacement character for every byte that isn't part of a character."""
    out = []
    while data:
        try:
            out.append(data.decode())
            break
        except UnicodeDecodeError as bad:
            out += [data[: bad.start].decode(), "�"]
            data = data[bad.start + 1 :]
    return "".join(out)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"


def _run(path: str, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = of_process(Pieces, path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, len(whole), SLICE)):
            encoded = coder.encode([t or "" for t in batch.column(1).to_pylist()])
            texts = [coder.decode(ids) for ids, _ in encoded]
            cols = [batch.column(0), pa.array([len(i) for i, _ in encoded], pa.int64()), pa.array([sha(i.tobytes()) for i, _ in encoded]), pa.array([sha(t.encode()) for t in texts]), pa.array([zlib.crc32(s.astype("<u4").tobytes()) for _, s in encoded], pa.int64())]
            names = [x.split()[0] for x in DIGESTS.split(", ")]
            if full:
                cols += [pa.array([i.astype(np.int64) for i, _ in encoded], pa.list_(pa.int64())), pa.array([s.tolist() for _, s in encoded], pa.list_(pa.list_(pa.int64()))), pa.array(texts)]
                names += ["ids", "spans", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def encode_decode(docs: DataFrame, model: str, full: bool = False) -> DataFrame:
    """Encode and decode every text of ``docs`` (doc_id, text); ``full`` adds ids, spans ([begin, end) in source bytes, a pair for each id) and the decoded text. No shuffle."""
    schema = DIGESTS + (", ids array<long>, spans array<array<long>>, decoded string" if full else "")
    return docs.select("doc_id", "text").mapInArrow(_run(model, full), schema)
