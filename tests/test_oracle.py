"""Every query with oracle SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import pytest

from wavemark.catalog import ORACLE_SQL, QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(name, spark, duck):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect()]
    r = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    want = [tuple(plain(row[names.index(c)]) for c in columns) for row in r.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


#: Queries without oracle SQL, and where they are compared with NumPy, brute force or the files themselves.
COMPARED = {
    "test_registered.py": {"sp_bandpass", "sp_notch", "sp_regression", "sp_segment_filtered", "sp_overview_filtered", "sp_coarse", "sp_plot_segment", "sp_display_segment", "sp_export_waveform", "sp_psd", "sp_spectrogram", "sp_find_peaks", "topk_peak_nms", "topk_peak_distance", "fn_fingerprint", "join_source_fingerprint"},
    "test_whole_curve.py": {"sp_led_refine"},
    "test_peak_display.py": {"sp_peak_display"},
}


def test_every_other_query_is_compared_somewhere():
    assert set(QUERIES) - set(ORACLE_SQL) == set().union(*COMPARED.values())
    for name, queries in COMPARED.items():
        with open(os.path.join(os.path.dirname(__file__), name)) as f:
            text = f.read()
        assert all(f'"{q}"' in text for q in queries)
