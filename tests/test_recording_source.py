"""Recordings in windows of bytes: any window size and header depth gives the same rows as a plain walk through the file."""

import csv
import random

import numpy as np
import pytest

from wavemark.sources import recording_source as R, signal_csv as C


def written(tmp_path, depth=3, rows=400, odd=(), line_end="\n", last_end=True, name="one.csv"):
    r = random.Random(7)
    top = ["﻿Channels,2,5,260", "Sample Rate[Hz],10,10,10", *(f"Note {k},x" for k in range(depth - 3)), "Unit,µV,uV,uV", "Time[us],Channel 2,Channel 5,Channel 260"]
    data = [",".join([str(1000 * k), *("" if r.random() < 0.1 else f"{r.gauss(0, 50):.{r.randrange(9)}f}" for _ in range(3))]) for k in range(rows)]
    for k, line in odd:
        data[k] = line
    path = tmp_path / name
    path.write_bytes((line_end.join(top + data) + (line_end if last_end else "")).encode())
    return str(path)


def plain(path):
    """Row by row with the csv module: (time, cells)."""
    def number(x):
        try:
            return float(x)
        except ValueError:
            return None

    with open(path, encoding="utf-8-sig", newline="") as f:
        lines = f.read().splitlines()
    rows = [next(csv.reader([x]), []) for x in lines]
    header = next(k for k, x in enumerate(rows) if x and x[0].strip() == "Time[us]")
    return [[number(x[k]) if k < len(x) else None for k in range(4)] for x, line in zip(rows[header + 1 :], lines[header + 1 :], strict=True) if line.strip()]


def table(df):
    return sorted(map(tuple, df.collect()))


def wanted(path):
    return [(k, t, *(None if v is None else float(np.float32(v)) for v in cells)) for k, (t, *cells) in enumerate(plain(path))]


ODD = [(0, "0,x,1,2"), (5, ""), (6, "   "), (50, "50000,1"), (51, "51000,1,2,3,4,5"), (90, '"90000","7",,"8"'), (91, "later,1,2,3"), (200, "200000, 4 ,-0.5,1e-3"), (201, ","), (399, "399000,1,2,")]


@pytest.mark.parametrize("options", [{}, {"depth": 500}, {"line_end": "\r\n"}, {"last_end": False}, {"odd": ODD}, {"odd": ODD, "last_end": False, "depth": 900}, {"rows": 0}])
def test_any_window_gives_the_same_rows(spark, tmp_path, options):
    path = written(tmp_path, **options)
    want = wanted(path)
    assert C.metadata(spark, path) == {"channels": [2, 5, 260], "sample_rates": [10.0] * 3, "header_row": options.get("depth", 3), "data_column_count": 4, "time_unit": "s", "value_unit": "uV"}
    for size in (700, 1 << 20):
        assert table(C.read(spark, path, window_bytes=size)) == want
    source = R.Recordings({"path": path})
    for size in (3, 29, 100):  # many windows within and beside lines
        reader = R.RecordingReader(path, [0, 1, 2, 3], source.schema(), size, False)
        values = [row[2:] for p in reader.partitions() for b in reader.read(p) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert len(reader.partitions()) > 50 * bool(want) and values == [x[1:] for x in want]
    found = C.chunks(spark, path, 1000).collect()
    assert sum(r.n for r in found) == sum(t is not None for _, t, *_ in want)


def test_the_csv_reader_of_spark_gives_the_same(spark, tmp_path, monkeypatch):
    """For file systems that Python can't open."""
    for k, options in enumerate(({"odd": ODD}, {"depth": 700}, {"depth": 60}, {"rows": 2})):
        path = written(tmp_path, name=f"{k}.csv", **options)
        top, rows = C.metadata(spark, path), table(C.read(spark, path, [260, 5]))
        with monkeypatch.context() as m:
            m.setattr(C, "can_open", lambda path: False)
            assert C.metadata(spark, path) == top and table(C.read(spark, path, [260, 5])) == rows


def test_a_folder_of_parts(spark, tmp_path, monkeypatch):
    """Parts in the order of their numbers, the metadata in the first; the same as one file, by either reader."""
    one = written(tmp_path, odd=[x for x in ODD if x[0] != 399])
    lines = open(one, encoding="utf-8").read().splitlines(keepends=True)
    folder = tmp_path / "parts.csv"
    folder.mkdir()
    for k, (a, b) in enumerate(((0, 4), (4, 4), (4, 30), (30, 31), (31, 999))):
        (folder / f"part-{k:05d}-x.txt").write_text("".join(lines[a:b]), encoding="utf-8")
    (folder / "part-100000-x.txt").write_text("")
    (folder / "_SUCCESS").write_text("")
    (folder / ".part-00000-x.txt.crc").write_bytes(b"\xff")
    want, top = wanted(one), C.metadata(spark, one)
    for size in (300, 1 << 20):
        assert C.metadata(spark, str(folder)) == top and table(C.read(spark, str(folder), window_bytes=size)) == want
    assert C.preview(spark, str(folder), 6) == C.preview(spark, one, 6) and len(C.preview(spark, one, 6)) == 6
    with monkeypatch.context() as m:
        m.setattr(C, "can_open", lambda path: False)
        assert C.metadata(spark, str(folder)) == top and table(C.read(spark, str(folder))) == want
        assert C.preview(spark, str(folder), 6) == C.preview(spark, one, 6)


def test_written_in_parts_or_as_one_file(spark, tmp_path):
    wide = spark.range(5000).selectExpr("id AS row", "id * 1000.0D AS time_us", "float(id % 7) AS channel_3", "float(if(id % 5 = 0, NULL, id)) AS channel_12").repartition(6)
    for k, single in enumerate((False, True)):
        path = f"{tmp_path}/{k}.csv"
        C.write_csv(wide, path, [3, 12], 1000.0, one_file=single)
        got = C.read(spark, path, window_bytes=9000).orderBy("row").collect()
        assert got == wide.orderBy("row").collect() and C.metadata(spark, path)["channels"] == [3, 12]


def test_only_asked_channels_are_read_and_filters_reach_the_source(spark, tmp_path):
    path = written(tmp_path, odd=ODD)
    df = C.read(spark, path, [260], window_bytes=1000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "channel_260" in plan and "channel_5" not in plan
    want = [r for r in table(df) if r[1] is not None and 100_000 <= r[1] < 250_000]
    old = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    for setting in ("true", "false"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", setting)
        try:
            some = C.read(spark, path, [260], window_bytes=1000).where("time_us >= 100000 and time_us < 250000")
            assert table(some) == want
        finally:
            spark.conf.set("spark.sql.python.filterPushdown.enabled", old)
    reader = R.FilteringReader(path, [0, 3], R.Recordings({"path": path, "channels": "260"}).schema(), 1000, False)
    list(reader.pushFilters([R.GreaterThanOrEqual(("time_us",), 100_000.0), R.LessThan(("time_us",), 250_000.0), R.EqualTo(("channel_260",), 1.0)]))
    kept = [t for p in reader.partitions() for b in reader.read(p) for t in b.column(2).to_pylist()]
    assert len(reader.filters) == 2 and [t for t in kept if t is not None] == [r[1] for r in want] and len(kept) < 250


def test_what_is_missing_is_an_error(spark, tmp_path):
    path = tmp_path / "none.csv"
    path.write_text("Channels,1\n" + "a,b\n" * 300)
    assert C.metadata(spark, str(path))["header_row"] is None
    for call in (lambda: C.read(spark, str(path)), lambda: C.data_header(spark, str(path)), lambda: C.read(spark, written(tmp_path), [2, 4])):
        with pytest.raises(ValueError):
            call()
    assert C.metadata(spark, written(tmp_path, rows=0))["header_row"] == 3


@pytest.mark.parametrize(("rows", "unit"), [
    ([["Unit", "mV"], ["Time[us]", "a"], ["Unit", "V"]], "mV"),
    ([["Time[us]", "a"], [], ["1", "2"], ["units", "", " V "], ["Unit", "W"]], "V"),
    ([["Time[us]", "a"], *[["1", "2"]] * 8, ["Unit", "V"]], ""),
    ([["Time[us]", "a"], *[["1", "2"]] * 7, ["Unit", "V"]], "V"),
    ([["UNIT", "mV"], ["Unit", "uV"], ["Time[us]", "a"]], "uV"),
])
def test_units(rows, unit):
    assert R.describe(rows)["value_unit"] == unit
