"""Quality rules: learned decision lists over text statistics, in DataFrame functions only.

Statistics are expressions of the text alone; nothing is shuffled for them. A decision list is
learned by sequential covering: a rule grows threshold by threshold (FOIL gain) on two thirds
(of the good and of the bad rows) of a bounded sample of labelled rows that pass the base rule, is pruned on the last third, and
joins the list when it is precise enough there; rows it covers leave the sample. A rule that is not precise
enough is left out, the bad rows that it grew on stop growing rules, and the search goes on. The list becomes one ordered conditional
expression. The sample's bound is a documented parameter (``most_rows``); all else covers all rows.

Edge cases: null, empty and wordless texts have zero statistics and fail the base rule; texts
of any length are read whole; without labels of both kinds the list is empty and only the base
rule decides; rows with equal or null doc_ids are judged one by one, null ids never teach.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
MOST_ROWS = 20_000


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words in runs of three that occur twice or more: runs sort next to their equals, places of equals merge."""

    def of(w: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.concat(w[i], F.lit(" "), w[i + 1], F.lit(" "), w[i + 2], F.lit(" "), F.lpad(i.cast("string"), 10, "0")),
        )

        def covered(t: Column) -> Column:
            keys = F.transform(t, lambda x: F.substring(x, F.lit(1), F.length(x) - 10))
            places = let(
                keys,
                lambda k: F.filter(
                    F.sequence(F.lit(0), F.size(k) - 1),
                    lambda i: ((i > 0) & (k[i] == k[F.greatest(i - 1, F.lit(0))])) | ((i < F.size(k) - 1) & (k[i] == k[F.least(i + 1, F.size(k) - 1)])),
                ),
            )
            at = F.array_sort(F.transform(places, lambda i: F.substring(t[i], F.lit(-10), F.lit(10)).cast("int")))
            start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
            step = lambda acc, i: F.struct((i + 3).alias("end"), (acc["n"] + (i + 3 - F.greatest(acc["end"], i))).cast("long").alias("n"))
            return F.aggregate(at, start, step, lambda acc: acc["n"])

        return let(F.sort_array(runs), covered)

    return F.when(F.size(words) >= 3, let(words, of)).otherwise(F.lit(0).cast("long"))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and the ratios that rules may use."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("words", F.filter(F.split("text", SPACE, -1), lambda w: w != "")).withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    length = lambda pattern: F.length(F.regexp_replace("text", pattern, "")).cast("long")
    counted = base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        length(SPACE).alias("word_chars"),
        length(SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        length(r"[^A-Z]+").alias("n_upper"),
        length(r"[^0-9]+").alias("n_digit"),
        length(r"[^!?.,;:]+").alias("n_punct"),
        length(r"[^!]+").alias("n_bang"),
    )
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return counted.select(
        "doc_id",
        *COUNTS,
        per("word_chars", "n_words").alias("mean_word"),
        per("n_symbols", "word_chars").alias("symbol_ratio"),
        per("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        per("n_repeat_words", "n_words").alias("repeat_ratio"),
        per("n_distinct", "n_words").alias("distinct_ratio"),
        per("n_upper", "word_chars").alias("upper_ratio"),
        per("n_digit", "word_chars").alias("digit_ratio"),
        per("n_punct", "n_words").alias("punct_ratio"),
        per("n_bang", "n_words").alias("bang_ratio"),
        per("n_words", "n_lines").alias("line_words"),
    )


FEATURES = ["n_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "upper_ratio", "digit_ratio", "punct_ratio", "bang_ratio", "line_words"]


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def hits(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        c = F.col(self.feature).cast("double")
        return c > self.threshold if self.above else c <= self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.hits(x)
    return out


def grow(x: dict[str, np.ndarray], bad: np.ndarray, depth: int = 4, steps: int = 48) -> Rule:
    """Add the threshold with the most FOIL gain until only bad rows are covered or nothing gains."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < depth:
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p0 or not n0:
            break
        best, gain, now = None, 1e-9, np.log2(p0 / (p0 + n0))
        for f, v in x.items():
            for t in np.unique(np.quantile(v[inside], np.linspace(0, 1, steps))).tolist():
                for above in (True, False):
                    c = Condition(f, above, t)
                    hit = inside & c.hits(x)
                    p = int((hit & bad).sum())
                    if p and (g := p * (np.log2(p / int(hit.sum())) - now)) > gain:
                        best, gain = c, g
        if best is None:
            break
        rule, inside = (*rule, best), inside & best.hits(x)
    return rule


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float, int]:
    """The prefix of the rule with the best (p - n) / (p + n) on rows that did not grow it; its precision and cover."""
    best: tuple[Rule, float, int] = ((), 0.0, 0)
    worth = -2.0
    for k in range(len(rule), 0, -1):
        hit = covers(rule[:k], x, len(bad))
        total, p = int(hit.sum()), int((hit & bad).sum())
        if total and (w := (2 * p - total) / total) > worth:
            best, worth = (rule[:k], p / total, total), w
    return best


def learn(rows: list[tuple], precision: float = 0.9, least: int = 4, most_rules: int = 16) -> list[Rule]:
    """Rules, in order, that mark bad rows. ``rows``: FEATURES and a label (1 good, 0 bad). A rule covers ``least`` rows, one or more of them not grown on."""
    if not rows:
        return []
    table = np.array(rows, float)
    x = {f: table[:, i] for i, f in enumerate(FEATURES)}
    bad = table[:, -1] == 0
    third = np.zeros(len(table), bool)
    for kind in (bad, ~bad):
        third[np.flatnonzero(kind)[2::3]] = True
    left, seeds, out = np.ones(len(table), bool), bad & ~third, []
    while len(out) < most_rules and seeds.sum() >= 2:
        a, b = left & ~third & (seeds | ~bad), left & third
        rule = grow({f: v[a] for f, v in x.items()}, bad[a])
        if not rule:
            break
        grown = covers(rule, x, len(table))
        rule, right, cover = prune(rule, {f: v[b] for f, v in x.items()}, bad[b])
        held = covers(rule, x, len(table)) & left
        if rule and cover and right >= precision and held.sum() >= least and (held & bad).sum() >= precision * held.sum():
            out.append(rule)
            left &= ~held
        tried = seeds & (grown | ~left)
        if not tried.any():
            break
        seeds &= ~tried
    return out


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional: the first rule that holds drops the row."""
    out = F
    for rule in rules:
        holds = F.lit(True)
        for c in rule:
            holds = holds & c.column()
        out = out.when(holds, F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def labelled_sample(stats: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> list[tuple]:
    """At most ``most_rows`` labelled rows that pass the base rule, in the order of a hash of their doc_ids."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = stats.where(~base_failed()).join(known, "doc_id").orderBy(F.xxhash64("doc_id"), *FEATURES).limit(most_rows)
    return [tuple(r) for r in rows.select(*FEATURES, "quality").collect()]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, base counts, base_failed and kept for every row of ``docs``."""
    stats = stage(statistics(docs), "statistics")
    rules = learn(labelled_sample(stats, labels, most_rows))
    failed = base_failed()
    return stats.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
