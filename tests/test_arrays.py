"""Running sums against itertools."""

import itertools
import random
import time

from docketloom.functions import arrays


def test_running_sums(spark):
    r = random.Random(4)
    rows = [(i, [r.randrange(-5, 100) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 7, 8, 9, 63, 64, 65, 500, 5000])] + [(99, None)]
    df = spark.createDataFrame(rows, "i int, v array<int>")
    got = {x.i: x.s for x in df.select("i", arrays.running_sums(df.v).alias("s")).collect()}
    assert got == {i: None if v is None else list(itertools.accumulate(v)) for i, v in rows}


def test_long_arrays(spark):
    df = spark.range(1).selectExpr("transform(sequence(1, 300000), x -> x % 7) v")
    began = time.time()
    total = df.select(arrays.running_sums(df.v).alias("s")).selectExpr("element_at(s, -1) t", "size(s) n").first()
    assert (total.t, total.n) == (sum(x % 7 for x in range(1, 300001)), 300000) and time.time() - began < 30
