"""Routing instructions of a charge, read back from its text: the inverse of ``resolve.routing_sentences``.

A text is cut at question headings and at lines of rulings, which no instruction crosses; inside a part, instructions and their conditions are
matched. Headings count by their order, not by the number printed, and 'the following question' is the next heading's.
Whitespace counts as one space, so wrapped lines don't matter. Null and empty texts have no instructions.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import large

# A heading is in capitals, a reference is not; how instructions and their conditions are worded, in two styles.
HEADING, RULING = re.compile(r"QUESTION\s+NO\.\s*\d+"), re.compile(r"GRANTED:")
CONDITION = re.compile(
    r"(?P<u>unanimously\s+)?answered\s+[“\"‘']?(?P<answer>yes|no)[”\"’']?\s+to\s+(?:both\s+)?Question\s+No\.?\s*(?P<source>\d+)"
    r"|(?P<u2>unanimous\s+)?answer\s+to\s+question\s+(?:No\.?\s*)?(?P<source2>\d+)\s+is\s+[“\"‘']?(?P<answer2>yes|no)[”\"’']?",
    re.IGNORECASE,
)
THEN = re.compile(r",\s*then\s+answer\s+(?:Question\s+No\.?\s*(?P<n>\d+)|question\s+(?P<n2>\d+)|the\s+following\s+(?P<next>questions?))", re.IGNORECASE)
IF = re.compile(r"\bIf\s+(?:your?\s+)?", re.IGNORECASE)
LONGEST = 520


def conditions(body: str) -> list[tuple[int, str, bool]]:
    """(source, answer, unanimous), each once."""
    found = ((int(m["source"] or m["source2"]), (m["answer"] or m["answer2"]).title(), bool(m["u"] or m["u2"])) for m in CONDITION.finditer(body))
    return sorted(set(found))


def instructions(text: str) -> list[tuple[int, int | None, str, list[tuple[int, str, bool]]]]:
    """(offset, target, kind, conditions) in order; kind: numbered, following, group (no single target) or lost (nothing follows)."""
    text = re.sub(r"\s+", " ", text)
    heads = [m.start() for m in HEADING.finditer(text)]
    stops = sorted([*heads, *(m.start() for m in RULING.finditer(text)), len(text)])
    out, at = [], 0
    for stop in stops:
        opens = [m.end() for m in IF.finditer(text, at, stop)]
        done = at
        for m in THEN.finditer(text, at, stop):
            # the first 'if' after the last instruction whose body speaks of an answer and isn't too long
            low, high = bisect.bisect_left(opens, max(done, m.start() - LONGEST)), bisect.bisect_right(opens, m.start())
            begin = next((o for o in opens[low:high] if re.search(r"(?i)answer", text[o : m.start()])), None)
            if begin is None:
                continue
            done = m.end()
            if m["next"]:
                k = bisect.bisect_right(heads, m.end())
                kind = "group" if m["next"].lower().endswith("s") else "following" if k < len(heads) else "lost"
                target = k + 1 if kind == "following" else None
            else:
                kind, target = "numbered", int(m["n"] or m["n2"])
            out.append((begin, target, kind, conditions(text[begin : m.start()])))
        at = stop
    return out


ROUTE = "array<struct<source:int,answer:string,unanimous:boolean>>"


def routes(docs: DataFrame) -> DataFrame:
    """doc_id, at, target, kind, conditions of every instruction of ``docs`` (doc_id, text)."""
    struct = pa.struct([("source", pa.int32()), ("answer", pa.string()), ("unanimous", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, at, target, kind, [dict(zip(("source", "answer", "unanimous"), c, strict=True)) for c in found]) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for at, target, kind, found in instructions(t)]
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(struct)), strict=True)], ["doc_id", "at", "target", "kind", "conditions"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, at int, target int, kind string, conditions {ROUTE}")


def expected(predicates: DataFrame, others: DataFrame, numbers: DataFrame) -> DataFrame:
    """doc_id, target, want: what each question of a map depends on. predicates: doc_id, node, source, answer, unanimous; others: doc_id, node, target, kind; numbers: doc_id, key, number."""
    source = large(numbers.select("doc_id", F.col("key").alias("source"), F.col("number").alias("s")))
    target = large(numbers.select("doc_id", F.col("key").alias("node"), F.col("number").alias("target")))
    given = predicates.select("doc_id", "node", "source", "answer", F.coalesce("unanimous", F.lit(False)).alias("unanimous"))
    no = lambda rows, node, source: rows.select("doc_id", F.col(node).alias("node"), F.col(source).alias("source"), F.lit("No").alias("answer"), F.lit(False).alias("unanimous"))
    all_ = given.union(no(others.where("kind = 'blocks'"), "target", "node")).union(no(others.where("kind = 'alternative'"), "node", "target"))
    known = all_.join(source, ["doc_id", "source"]).join(target, ["doc_id", "node"])
    return known.groupBy("doc_id", "target").agg(F.array_sort(F.collect_set(F.struct(F.col("s").cast("int").alias("source"), "answer", "unanimous"))).alias("want"))


def checked(found: DataFrame, want: DataFrame) -> DataFrame:
    """doc_id, target, status, unexpected: a row for each instruction (``routes``) and for each question of a map (``expected``) that none leads to.

    matched: its conditions are among those expected; mismatch; unparsed: it has none; unmapped: the map has none for its target; group, lost: no single target; missing.
    """
    found, known = found.withColumn("_found", F.lit(True)), large(want.withColumn("_known", F.lit(True)))
    both = found.join(known, ["doc_id", "target"], "full")  # one pass over the texts: what is read back and what is missing
    none = F.array().cast(ROUTE)
    extra = F.array_except("conditions", F.coalesce("want", none))
    status: Column = (
        F.when(F.col("_found").isNull(), "missing").when(F.col("kind").isin("group", "lost"), F.col("kind")).when(F.col("_known").isNull(), "unmapped").when(F.size("conditions") == 0, "unparsed").when(F.size(extra) == 0, "matched").otherwise("mismatch")
    )
    return both.select("doc_id", "target", status.alias("status"), F.when(F.col("_found") & F.col("_known"), extra).otherwise(none).alias("unexpected"))
