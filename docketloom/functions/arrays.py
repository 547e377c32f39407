"""Arrays inside a row, without copying an array for every element."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though ``body`` names it in lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _fold(values: Column) -> Column:
    """Running sums of a few values: each step copies what is there."""
    return F.aggregate(values, F.array().cast("array<long>"), lambda acc, x: F.array_append(acc, F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + x))


def running_sums(values: Column, levels: int = 3) -> Column:
    """Sums of each value and all before it (long), of an array without nulls, in blocks of blocks: n values cost n^(4/3) steps, not n^2."""

    def blocked(v: Column, levels: int) -> Column:
        if levels == 1:
            return _fold(v)
        n = F.size(v)
        width = F.greatest(F.lit(8), F.ceil(F.pow(n.cast("double"), 1 / levels)).cast("int"))
        cuts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int"))).otherwise(F.array().cast("array<int>"))
        inner = lambda w: F.transform(cuts, lambda k: _fold(F.slice(v, k * w + 1, w)))

        def shifted(sums: Column) -> Column:
            ends = F.transform(sums, lambda s: F.element_at(s, -1))
            before = let(blocked_(ends, levels - 1), lambda b: F.transform(b, lambda x, i: F.when(i == 0, F.lit(0)).otherwise(F.get(b, i - 1))))
            return F.flatten(F.zip_with(sums, before, lambda s, o: F.transform(s, lambda x: x + o)))

        return let(width, lambda w: let(inner(w), shifted))

    def blocked_(v: Column, levels: int) -> Column:
        return let(v, lambda x: blocked(x, levels))

    return F.when(values.isNotNull(), blocked_(F.transform(values, lambda x: x.cast("long")), levels))


def by_row(f: Callable, kind: str, *columns: Column) -> Column:
    """``f`` row by row over Arrow batches, for work that a fold could only do by copying what it has for every element. A null in any column gives null."""

    @F.pandas_udf(kind)
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None for x in row) else f(*row) for row in zip(*series, strict=True)], dtype=object)

    return run(*columns)
