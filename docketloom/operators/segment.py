"""Segmentation: sentences, masks, paragraph chunks, batches."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import by_row
from .citations import masked as mask_citations

# Abbreviations that end no sentence.
ABBREVIATIONS = set("v vs no nos art sec ch cf id e.g i.e al etc mr mrs ms dr jr sr st co inc ltd corp dept div app supp ct cir rev stat ann ex".split())


MARK = re.compile(r"[.!?]+[\"'”’)\]]*(?=\s|$)|\n\s*\n")
WORD_BEFORE, NEXT, BLANK = re.compile(r"[\w.]+$"), re.compile(r"\s*(\S)"), re.compile(r"\s*")
LONGEST = max(map(len, ABBREVIATIONS)) + 1


def _ends(text: str, m: re.Match, start: int) -> bool:
    """Whether a mark ends a sentence: not after an abbreviation or an initial, nor before a lower-case letter or a digit. Looks at a few characters on both sides only."""
    if not m[0].startswith("."):
        return True
    low = max(start, m.start() - LONGEST)
    word = WORD_BEFORE.search(text[low : m.start()])
    if word and (low == start or word.start()) and (word[0].lower() in ABBREVIATIONS or (len(word[0]) == 1 and word[0].isupper())):
        return False
    after = NEXT.match(text, m.end())
    return not (after and (after[1].islower() or after[1].isdigit()))


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """[start, end) of sentences: a mark of the end, closing quotes, then space and no lower-case letter or digit, unless an abbreviation or initial stands before."""
    out, start, size = [], 0, len(text.rstrip())
    for m in MARK.finditer(text):
        if _ends(text, m, start):
            begin = BLANK.match(text, start).end()
            if begin < (end := m.start() if m[0].startswith("\n") else m.end()):
                out.append((begin, end))
            start = m.end()
    begin = BLANK.match(text, start).end()
    return [*out, (begin, size)] if begin < size else out


def sentence_at(begins: list[int], at: int) -> int:
    """Index of the sentence around an offset, or the one before it if it stands between two; -1 before the first."""
    return bisect.bisect_right(begins, at) - 1


def clamped(span: tuple[int, int], at: int, most: int = 700) -> tuple[int, int]:
    """A span of more than ``most`` characters cut to half as many on both sides of an offset in it."""
    start, end = span
    return span if end - start <= most else (max(start, at - most // 2), min(end, at + most // 2))


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, i, start, end of every sentence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, i, s, e) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for i, (s, e) in enumerate(sentence_spans(t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "i", "start", "end"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, i int, start int, end int")


def masked(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [None if t is None else mask_citations(t) for t in pdf["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, text string")


TOKEN = re.compile(r"\w+|[^\w\s]")
# What parts a text, the strongest first; a cut is made where the strongest stands.
BOUNDARIES = [re.compile(p) for p in (r"\n\s*\n", r"\n", r"[.!?][\"'”’)\]]*\s", r"[;:]\s", r",\s", r"\s")]


def token_chunks(text: str, budget: int, tokens: Callable[[str], Iterable[int]] | None = None) -> list[tuple[int, int]]:
    """[start, end) of chunks of at most ``budget`` tokens that together are the text.

    A chunk is cut in its second half, at the last of the strongest boundaries there (paragraph, line, sentence, clause, comma, space, else anywhere
    between tokens). ``tokens`` gives where a text's tokens begin, in order; by default words and marks. Linear: each token is looked at twice at most.
    """
    starts = list(tokens(text)) if tokens else [m.start() for m in TOKEN.finditer(text)]
    if not text or budget < 1:
        return [(0, len(text))] if text else []
    levels = [len(BOUNDARIES)] * len(starts)
    for level in range(len(BOUNDARIES) - 1, -1, -1):
        at = 0
        for m in BOUNDARIES[level].finditer(text):
            at = bisect.bisect_left(starts, m.end(), at)
            if at < len(starts) and (at == 0 or starts[at - 1] < m.end()):
                levels[at] = min(levels[at], level)
    out, first, begin = [], 0, 0
    while len(starts) - first > budget:
        places = range(first + budget, first + budget // 2, -1)
        cut = min(places, key=levels.__getitem__)  # the first of equals is the last place
        out.append((begin, starts[cut]))
        first, begin = cut, starts[cut]
    return [*out, (begin, len(text))]


def chunked(docs: DataFrame, budget: int = 512) -> DataFrame:
    """doc_id, i, start, end, text of the chunks of ``docs`` (doc_id, text). Null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, i, a, b, t[a:b]) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, (a, b) in enumerate(token_chunks(t or "", budget))]
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["doc_id", "i", "start", "end", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, i int, start int, end int, text string")


def paragraph_chunks(text: str, target: int, separator: str = "\n\n") -> list[str]:
    done, open_, n = [], [], 0
    for p in (x.strip(" ") for x in text.split(separator)):
        if not p:
            continue
        if open_ and n + len(p) > target:
            done.append(separator.join(open_))
            open_, n = [p], len(p)
        else:
            open_.append(p)
            n += len(p) + 2
    return [*done, separator.join(open_)] if open_ else done


def chunks(text: Column, target: int, separator: str = "\n\n") -> Column:
    """Paragraphs packed in order until the target length: a paragraph counts two more, but for the one that opens a chunk after a flush."""
    return by_row(lambda t: paragraph_chunks(t, target, separator), "array<string>", text)


def part_starts(text: str, parts: list[str]) -> list[int]:
    out, at = [], 0
    for p in parts:
        found = text.find(p, at)
        out.append(found if found >= 0 else at - 1)
        at = out[-1] + len(p)
    return out


def offsets(text: Column, parts: Column) -> Column:
    """Start of each part, searched for from the end of the part before."""
    return by_row(part_starts, "array<int>", text, parts)


def chunk_places(docs: DataFrame, target: int, separator: str = "\n\n") -> DataFrame:
    """doc_id, i, start, n_chars of the ``chunks`` of ``docs`` (doc_id, text). A worker holds the chunks of one text at a time; null texts have none."""
    kinds, names = (pa.int64(), pa.int32(), pa.int32(), pa.int32()), ["doc_id", "i", "start", "n_chars"]

    def placed(d: int, t: str) -> Iterator[tuple[int, int, int, int]]:
        parts = paragraph_chunks(t, target, separator)
        return ((d, i, s, len(p)) for i, (s, p) in enumerate(zip(part_starts(t, parts), parts, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for d, t in zip(batch.column(0), batch.column(1), strict=True) if t.is_valid for r in placed(d.as_py(), t.as_py())]
            cols = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, i int, start int, n_chars int")


def batch_numbers(keys: list[str], most: int, most_chars: int) -> list[int]:
    out, b, n, c = [], 0, 0, 0
    for k in keys:
        size = len(k) + 1
        if n + 1 > most or c + size > most_chars:
            b, n, c = b + (n > 0), 1, size
        else:
            n, c = n + 1, c + size
        out.append(b)
    return out


def batches(keys: Column, most: int = 250, most_chars: int = 64_000) -> Column:
    """Batch numbers of ordered keys: at most ``most`` keys and ``most_chars`` characters in each."""
    return by_row(lambda ks: batch_numbers(ks, most, most_chars), "array<int>", keys)
