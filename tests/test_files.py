import csv
import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemark.operators import blocks, led, samples as O
from wavemark.sources import files, ttl

ROWS = [(3, "plain", 1.5), (1, 'has "quotes", commas', None), (2, "two\r\nlines", -2.0), (4, None, 0.1)]


def frame(spark):
    return spark.createDataFrame(ROWS * 1, "k long, note string, x double").repartition(3)


def test_csv_is_one_file_in_order(spark, tmp_path):
    path = str(tmp_path / "out.csv")
    for _ in range(2):  # the second takes the first one's place
        files.write_csv(frame(spark), path, ["note", "x"], ["k"])
    data = open(path, "rb").read()
    assert data.startswith(b"\xef\xbb\xbf") and not any("part" in p.name for p in tmp_path.iterdir() if not p.name.startswith("."))
    got = list(csv.reader(io.StringIO(data.decode("utf-8-sig"), newline="")))
    assert got == [["note", "x"], *([n or "", "" if x is None else str(x)] for _, n, x in sorted(ROWS))]
    assert data.count(b"\r\n") == 6


def test_a_write_that_fails_leaves_the_old_file(spark, tmp_path):
    path = str(tmp_path / "out")
    with files.replacing(spark, path) as out:
        out.write(bytearray(b"old"))
    with pytest.raises(RuntimeError), files.replacing(spark, path) as out:
        out.write(bytearray(b"new"))
        raise RuntimeError
    assert open(path, "rb").read() == b"old" and not (tmp_path / "out.part").exists()


def test_workbooks(spark, tmp_path):
    path = str(tmp_path / "out.xlsx")
    files.write_xlsx(frame(spark), path, ["k", "note", "x"], ["k"], "Markers & more")
    got = [r.cells for r in files.read_xlsx(spark, path).orderBy("row").collect()]
    assert got == [["k", "note", "x"], *([str(k), n and n.replace("\r\n", "\n"), None if x is None else str(x)] for k, n, x in sorted(ROWS))]
    with zipfile.ZipFile(path) as z:
        assert b'name="Markers &amp; more"' in z.read("xl/workbook.xml") and b"<c><v>1.5</v></c>" in z.read("xl/worksheets/sheet1.xml")


def test_ttl_files(spark, tmp_path):
    path = str(tmp_path / "ttl.csv")
    ttl.write(spark.createDataFrame([(2, 1722384000000001, 90_061_000_001), (1, 1722384000000000, 5)], "marker_index int, local_us long, us long"), path)
    lines = open(path, encoding="utf-8-sig", newline="").read().split("\r\n")
    assert lines == ["marker_index,local_time(us),local_time,record_time(us),record_time", "1,1722384000000000,2024-07-31T08:00:00.000000,5,00:00:00.000005", "2,1722384000000001,2024-07-31T08:00:00.000001,90061000001,25:01:01.000001", ""]
    assert sorted((r.local_time_us, r.record_time) for r in ttl.read(spark, path).collect()) == [(1722384000000000, 5), (1722384000000001, 90061000001)]


def test_report_of_a_recording(spark):
    times = [0, 1000, 1000, None, 3000, 9000, 10_000]
    wide = spark.createDataFrame([(k, None if t is None else float(t), 1.0 if k != 1 else None, float("nan") if k == 6 else 2.0) for k, t in enumerate(times)], "row long, time_us double, channel_2 double, channel_5 double")
    got = [(r.Type, r.File, r.Value) for r in O.check_report(wide, 1000.0, 3, [2, 5], "a/rec.csv", chunk_rows=4).orderBy("ord").collect()]
    assert got == [
        ("Summary", "a/rec.csv", ""), ("Rows", "", "7"), ("Sample rate", "", "1000.0 Hz"), ("Expected interval", "", "1000 us"), ("Missing values", "", "3"), ("Duplicate timestamps", "", "1"), ("Discontinuous timestamps", "", "2"),
        ("Missing value", "line 8", "time=missing, channel=Time[us]"), ("Missing value", "line 6", "time=1000 us, channel=2"), ("Duplicate timestamp", "line 7", "1000 -> 1000 us (actual: 0 us, expected: 1000 us)"),
        ("Missing value", "line 11", "time=10000 us, channel=5"), ("Time discontinuity", "line 9", "1000 -> 3000 us (actual: 2000 us, expected: 1000 us)"), ("Time discontinuity", "line 10", "3000 -> 9000 us (actual: 6000 us, expected: 1000 us)"),
    ]


def plain_grey(frame, roi, turns):
    """Pixel by pixel: turned, cut, areas averaged, grey."""
    for _ in range(turns):
        frame = [[frame[y][len(frame[0]) - 1 - x] for y in range(len(frame))] for x in range(len(frame[0]))]
    x0, y0, w, h = roi
    cut = [row[x0 : x0 + w] for row in frame[y0 : y0 + h]]
    h, w = len(cut), len(cut[0]) if cut else 0
    if not h or not w:
        return 0.0
    mw, mh, total = max(w // 2, 1), max(h // 2, 1), 0
    for a in range(mh):
        for b in range(mw):
            means = []
            for c in range(3):
                s = sum(cut[y][x][c] * max(0, min((a + 1) * h / mh, y + 1) - max(a * h / mh, y)) * max(0, min((b + 1) * w / mw, x + 1) - max(b * w / mw, x)) for y in range(h) for x in range(w)) / (h / mh) / (w / mw)
                means.append(int(s + 0.5) if h % 2 == w % 2 == 0 else round(s))
            total += (means[0] * 1868 + means[1] * 9617 + means[2] * 4899 + 8192) >> 14
    return total / (mw * mh) / 255


def test_brightness_of_frames(spark):
    r = np.random.default_rng(3)
    frames = [r.integers(0, 256, (7, 10, 3), dtype=np.uint8) for _ in range(9)]
    rows = [(k, 10, 7, f.tobytes()) for k, f in enumerate(frames)] + [(20, 10, 7, b"short"), (21, 0, 0, b""), (22, 10, 7, None)]
    table = spark.createDataFrame([(k, w, h, None if p is None else bytearray(p)) for k, w, h, p in rows], "frame_index long, width int, height int, pixels binary")
    for roi, rotation in (((0, 0, 10, 7), 0), ((1, 2, 4, 4), 90), ((2, 1, 5, 3), 180), ((0, 3, 6, 5), 270), ((3, 3, 4, 2), 45), ((50, 50, 4, 4), 0)):
        got = {x.frame_index: x for x in led.brightness_curve(table, roi=roi, rotation=rotation, fps=25.0, step=3, start=1, end=7).collect()}
        assert sorted(got) == [1, 4, 7] and got[4].video_time_sec == 4 / 25.0
        for k, x in got.items():
            assert x.brightness == pytest.approx(plain_grey(frames[k].tolist(), roi, rotation // 90 if rotation % 90 == 0 else 0), abs=1e-12), (roi, rotation)


def test_ordered_operators_over_block_edges(spark):
    """Against plain loops, with blocks of a few rows."""
    r = np.random.default_rng(8)
    n = 400
    at = np.sort(r.choice(3000, n, replace=False))
    value = [None if r.random() < 0.6 else int(v) for v in r.integers(0, 50, n)]
    df = spark.createDataFrame([("a", int(i), v) for i, v in zip(at, value, strict=True)] + [("b", 5, None), ("b", 99, 1)], "k string, i long, v long").repartition(3)
    mine = lambda frame: sorted(frame.where("k = 'a'").collect(), key=lambda x: x.i)
    got = [x.p for x in mine(blocks.with_previous(df, F.col("v"), "p", ["k"], "i", 64))]
    assert got == [None, *value[:-1]]
    near = mine(blocks.with_nearest(df, F.col("v"), "a", "b", ["k"], "i", 64))
    for k, x in enumerate(near):
        assert x.a == next((v for v in value[k::-1] if v is not None), None) and x.b == next((v for v in value[k:] if v is not None), None)
    far = [x.f for x in mine(blocks.with_largest_before(df, "v", "f", ["k"], "i", 64))]
    assert far == [max((v for v in value[:k] if v is not None), default=None) for k in range(n)]
    runs = [x.run for x in mine(blocks.with_run(blocks.in_blocks(df, "i", 64), F.col("v") > 40, "run", ["k"], "i"))]
    assert runs == [next((int(at[j]) for j in range(k, -1, -1) if (value[j] or 0) > 40), None) for k in range(n)]
    assert [(x.r, x.n) for x in mine(blocks.with_number(df, "r", "n", ["k"], "i", 64))] == [(k, n) for k in range(n)]
    steps = spark.createDataFrame([("a", float(v)) for v in r.integers(1, 9, 301)] + [("b", 2.0), ("b", 5.0), ("c", 0.25)], "k string, d double")
    import statistics

    want = {"a": statistics.median([x.d for x in steps.where("k = 'a'").collect()]), "b": 3.5, "c": 0.25}
    assert {x.k: x.median for x in blocks.exact_median(steps, "d", ["k"]).collect()} == want
