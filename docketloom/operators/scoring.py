"""Scores of external models: an interface that takes any scorer, with chunks, failure isolation and a lexical stand-in.

A scorer is a callable: lists of propositions and of texts to a list of scores from 0 to 1. It is called on Arrow batches; where it raises,
the rows of the batch are scored one by one, and a row that fails again gets null. No vendor's model is emulated.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .segment import token_chunks

Scorer = Callable[[list[str], list[str]], list[float]]
CHUNK = 512


def words(text: str) -> set[str]:
    return set(re.findall(r"[a-z0-9]{3,}", text.lower()))


def lexical(propositions: list[str], texts: list[str]) -> list[float]:
    """Share of a proposition's distinct words of three characters or more that the text has."""
    out = []
    for p, t in zip(propositions, texts, strict=True):
        want = words(p)
        out.append(len(want & words(t)) / len(want) if want else 0.0)
    return out


def pieces(text: str, size: int) -> list[str]:
    """Runs of at most ``size`` characters, cut at spaces where there are any."""
    out, at = [], 0
    while at < len(text):
        to = len(text) if len(text) - at <= size else text.rfind(" ", at, at + size)
        to = to if to > at else min(len(text), at + size)
        out.append(text[at:to])
        at = to
    return out or [""]


def isolated(scorer: Scorer, propositions: list[str], texts: list[str]) -> list[float | None]:
    """Scores, null where the scorer fails on the row alone."""
    try:
        return list(scorer(propositions, texts))
    except Exception:  # noqa: BLE001 - the scorer is foreign code
        if len(texts) == 1:
            return [None]
        return [s for p, t in zip(propositions, texts, strict=True) for s in isolated(scorer, [p], [t])]


def support(pairs: DataFrame, scorer: Scorer = lexical, size: int | None = CHUNK) -> DataFrame:
    """id, score: for ``pairs`` (id, proposition, text) the best score of the text's chunks of ``size`` tokens at most (of the whole text if it is None). Null if any input is, or if no chunk could be scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, props, texts = (c.to_pylist() for c in batch.columns)
            flat = [(i, p, c) for i, (p, t) in enumerate(zip(props, texts, strict=True)) if p is not None and t is not None for c in ([t[a:b] for a, b in token_chunks(t, size)] or [t] if size else [t])]
            best: list[float | None] = [None] * len(ids)
            for (i, _, _), s in zip(flat, isolated(scorer, [p for _, p, _ in flat], [c for _, _, c in flat]) if flat else [], strict=True):
                if s is not None and (best[i] is None or s > best[i]):
                    best[i] = float(s)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(best, pa.float64())], ["id", "score"])

    return pairs.select("id", "proposition", "text").mapInArrow(run, "id long, score double")


def judged(score: Column) -> list[Column]:
    """supports (over a half) and inextractability (one less the score); both null without a score."""
    return [(score > 0.5).alias("supports"), (1 - score).alias("inextractability")]


def second_opinion(score: Column, answer: Column, low: float = 0.4, high: float = 0.6) -> Column:
    """A close call takes the extractive answer's score if there is one."""
    return F.when(score.between(low, high), F.coalesce(answer, score)).otherwise(score)
