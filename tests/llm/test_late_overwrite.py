import hashlib
import zlib
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketloom.llm import late_overwrite as lo
from docketloom.llm import queries
from docketloom.llm.common import shared_dir, stage
from tests.llm import samples

CUT, ZERO = datetime(2024, 3, 20), datetime(1970, 1, 1)
COLUMNS = ["sale_id", "client_id", "status", "total", "sold_at", "arrived_at", "priority"]


def day(r):
    return -1 if r["sold_at"] is None else (r["sold_at"] - ZERO).days


def crc(sale):
    return zlib.crc32(str(sale).encode())


def with_copies(rows):
    out = list(rows)
    for r in rows:
        if r["sale_id"] is not None and crc(r["sale_id"]) % 3 == 0 and day(r) % 4 == 0:
            h = crc(r["sale_id"])
            add = lambda x, d: None if x is None else x + timedelta(days=d)
            out.append(r | {"total": None if r["total"] is None else r["total"] + 1, "sold_at": add(r["sold_at"], h % 2), "arrived_at": add(r["arrived_at"], 1 + h % 97)})
    return out


def layout(rows, per_file):
    """{(day, file_no): rows} by definition."""
    best = {}
    for r in rows:
        rank = (r["arrived_at"] or datetime.min, r["sold_at"] or datetime.min)
        if r["sale_id"] not in best or rank > best[r["sale_id"]][0]:
            best[r["sale_id"]] = (rank, r)
    days = {}
    for _, r in best.values():
        days.setdefault(day(r), []).append(r)
    out = {}
    for d, rs in days.items():
        rs.sort(key=lambda r: (r["sold_at"] or datetime.min, -1 if r["sale_id"] is None else r["sale_id"]))
        out |= {(d, i // per_file): rs[i : i + per_file] for i in range(0, len(rs), per_file)}
    return out, {k: r for k, (_, r) in best.items()}


def micro(x):
    return "" if x is None else str((x - ZERO) // timedelta(microseconds=1))


def expected(rows, per_file):
    early = [r for r in rows if r["arrived_at"] is not None and r["arrived_at"] < CUT]
    _, stood = layout(early, per_file)
    files, kept = layout(rows, per_file)
    touched = set()
    for k, r in kept.items():
        if r["arrived_at"] is None or r["arrived_at"] >= CUT:
            touched |= {day(r)} | ({day(stood[k])} if k in stood else set())
    return {
        key: (
            len(rs),
            sum(0 if r["total"] is None else int((100 * r["total"] + 0.5) // 1) for r in rs),
            sum(zlib.crc32(":".join(["" if r["sale_id"] is None else str(r["sale_id"]), micro(r["sold_at"]), micro(r["arrived_at"])]).encode()) for r in rs),
            hashlib.sha256(",".join("" if r["sale_id"] is None else str(r["sale_id"]) for r in rs).encode()).hexdigest(),
            key[0] in touched,
        )
        for key, rs in files.items()
    }, files


def test_query(spark):
    sales = spark.read.parquet(f"{samples.SF}/sales.parquet").toPandas().astype(object)
    sales = sales.where(sales.notna(), None).to_dict("records")
    for r in sales:
        for c in ("sold_at", "arrived_at"):
            r[c] = r[c].to_pydatetime() if r[c] is not None else None
    want, files = expected(with_copies(sales), 1 + len(sales) // 1100)
    rows = queries.op13_late_overwrite(spark, samples.SF).collect()
    assert {(r.day, r.file_no): (r.n_rows, r.cents, r.rows_crc, r.ids_sha256, r.rewritten) for r in rows} == want
    assert {r.columns for r in rows} == {",".join(COLUMNS)} and any(r.rewritten for r in rows) and not all(r.rewritten for r in rows)
    for r in rows[:: max(1, len(rows) // 20)]:  # the files themselves
        table = pq.ParquetFile(r.path.removeprefix("file:").replace("%3D", "=")).read()
        assert table.column_names == COLUMNS
        assert table.column("sale_id").to_pylist() == [x["sale_id"] for x in files[r.day, r.file_no]]


SCHEMA = "sale_id long, sold_at timestamp_ntz, arrived_at timestamp_ntz, day string, _row_ string, m map<string,int>"


def rows_of(spark, rows):
    return stage(spark.createDataFrame([(*r, "d", "r", {"a": 1}) for r in rows], SCHEMA), "test-sales")


def contents(layout_, spark):
    rows = layout_.read(spark).select("day_", "file_no", "_metadata.file_path", "_metadata.row_index", "sale_id", "sold_at").collect()
    return {(r.day_, r.file_no): (r.file_path, [x.sale_id for x in sorted(rows, key=lambda x: x.row_index) if x.file_path == r.file_path]) for r in rows}


def test_edges(spark):
    d = lambda n, h=0: datetime(2024, 1, n, h)
    early = rows_of(spark, [(1, d(1, 5), d(1, 6)), (1, d(1, 5), d(1, 6)), (2, d(1, 5), d(1, 5)), (None, None, None), (None, None, d(2)), (3, d(2), d(2)), (4, d(3), d(3)), (5, d(4), d(4))])
    layout_ = lo.Layout(shared_dir(spark, "test-layout"), 1, early.schema)
    lo.lay_out(early, layout_)
    first = contents(layout_, spark)
    assert {k: v[1] for k, v in first.items()} == {(-1, 0): [None], (19723, 0): [1], (19723, 1): [2], (19724, 0): [3], (19725, 0): [4], (19726, 0): [5]}
    # 3 moves to a day of its own, which empties its old day; 2 is the same sale again, earlier; 4's late row has no arrival and loses
    late = rows_of(spark, [(3, datetime(1969, 12, 30, 1), d(9)), (2, d(8), d(1)), (4, d(8), None), (6, d(1, 1), d(9)), (6, d(1, 1), d(9))])
    lo.take_in(late, layout_)
    last = contents(layout_, spark)
    assert {k: v[1] for k, v in last.items()} == {(-1, 0): [None], (-2, 0): [3], (19723, 0): [6], (19723, 1): [1], (19723, 2): [2], (19725, 0): [4], (19726, 0): [5]}
    same = {k for k in last if k in first and first[k] == last[k]}
    assert same == {(-1, 0), (19725, 0), (19726, 0)}
    assert lo.Layout("x", 1, early.schema).day == "day_"
    row = layout_.read(spark).where("sale_id = 6").first()
    assert (row["day"], row["_row_"], row.m) == ("d", "r", {"a": 1})
    lo.take_in(rows_of(spark, [(1, d(1, 5), d(30)), (2, d(1, 5), d(30)), (6, d(3), d(30))]), layout_)  # fewer files in a day than before
    assert {k: v[1] for k, v in contents(layout_, spark).items() if k[0] in (19723, 19725)} == {(19723, 0): [1], (19723, 1): [2], (19725, 0): [4], (19725, 1): [6]}


@pytest.mark.parametrize("to", [2, 9])
def test_a_run_that_is_cut_off(spark, monkeypatch, to):
    d = lambda n: datetime(2024, 1, n)
    early = rows_of(spark, [(i, d(5), d(5)) for i in range(4)] + [(9, d(9), d(9)), (2, d(2), d(1))])
    layout_ = lo.Layout(shared_dir(spark, "test-layout"), 1, early.schema)
    lo.lay_out(early, layout_)
    late = rows_of(spark, [(3, d(to), d(20))])

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="lost"):
        m.setattr(lo, "_remove", dies)
        lo.take_in(late, layout_)
    assert sorted(i for _, ids in contents(layout_, spark).values() for i in ids) == [0, 1, 2, 3, 3, 9]
    lo.take_in(late, layout_)
    assert sorted(i for _, ids in contents(layout_, spark).values() for i in ids) == [0, 1, 2, 3, 9]


def test_empty(spark):
    none = spark.read.parquet(f"{samples.SF}/sales.parquet").where("false")
    layout_ = lo.Layout(shared_dir(spark, "test-layout"), 3, none.schema)
    lo.lay_out(stage(none, "none"), layout_)
    lo.take_in(stage(none, "none"), layout_)
    assert lo.report(layout_, spark, "total").count() == 0
    some = stage(spark.read.parquet(f"{samples.SF}/sales.parquet").limit(10), "some")
    lo.take_in(some, layout_)
    assert lo.files_of(layout_, spark).agg(F.sum("n_rows")).first()[0] == 10


def test_micros(spark):
    times = [datetime(2024, 2, 29, 23, 59, 59, 999999), datetime(1969, 12, 31, 23, 59, 58, 1), None]
    df = spark.createDataFrame([(t,) for t in times], T.StructType([T.StructField("t", T.TimestampNTZType())]))
    got = df.select(lo.micros(F.col("t")).alias("m"), lo.day_of(F.col("t")).alias("d")).collect()
    assert [(r.m, r.d) for r in got] == [((t - ZERO) // timedelta(microseconds=1), (t - ZERO).days) if t else (None, -1) for t in times]
