"""Pictures hold what all samples show: files parse, and their lines reach every column's lowest and highest value."""

from xml.etree import ElementTree

import numpy as np
from pyspark.sql import functions as F

from wavemark.operators import images as I

SAMPLES = "channel int, sample_index long, time_us double, value double"


def test_columns_and_files(spark, tmp_path):
    r = np.random.default_rng(6)
    x = r.normal(size=5000)
    rows = [(1, i, 10.0 * i, None if i % 11 == 3 else float("inf") if i % 97 == 0 else float(v)) for i, v in enumerate(x)] + [(2, 0, 5.0, 3.0), (3, 0, 1.0, None)]
    df = spark.createDataFrame(rows, SAMPLES).repartition(4)
    columns = I.pixel_columns(df, 0.0, 40_000.0, 64)
    got = {(c.channel, c.px): (c.first, c.last, c.low, c.high) for c in columns.collect()}
    want = {}
    for c, i, t, v in rows:
        if v is not None and np.isfinite(v) and t <= 40_000:
            want.setdefault((c, min(int(t / 40_000 * 64), 63)), []).append(v)
    assert got == {k: (v[0], v[-1], min(v), max(v)) for k, v in want.items()}
    path = f"{tmp_path}/pictures"
    for _ in range(2):  # an export again replaces the folder
        I.write_svg(I.as_svg(columns, 64, 100, F.lit("a < b & \"c\"\n")), path, "filtered")
    names = sorted(p.name for p in (tmp_path / "pictures").iterdir() if not p.name.startswith("."))
    assert names == ["channel1_filtered.svg", "channel2_filtered.svg"]
    root = ElementTree.parse(f"{path}/channel1_filtered.svg").getroot()
    line = root.find("{http://www.w3.org/2000/svg}polyline").get("points").split()
    assert root.find("{http://www.w3.org/2000/svg}title").text.strip() == 'a < b & "c"' and len(line) == 4 * 64
    lo, hi = min(v[2] for k, v in got.items() if k[0] == 1), max(v[3] for k, v in got.items() if k[0] == 1)
    pad = 0.05 * (hi - lo)
    for px in (0, 17, 63):
        ys = [float(p.split(",")[1]) for p in line if p.split(",")[0] == str(px)]
        assert np.allclose(ys, [(hi + pad - got[1, px][k]) / (hi - lo + 2 * pad) * 100 for k in (0, 2, 3, 1)], atol=0.006)
    assert I.read_svg(spark.read.option("wholetext", True).text(f"{path}/channel2_filtered.svg").select(F.lit("f").alias("file"), F.col("value").alias("svg"))).first().points == [[0.0, 50.0]] * 4
