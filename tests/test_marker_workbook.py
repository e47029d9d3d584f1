"""The workbook of markers on tables made for it: times whose shortest text ends in 5."""

import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from wavemark.catalog import ORACLE_SQL, QUERIES
from wavemark.functions import time_math as T
from wavemark.sources import files


def test_products_decide_what_is_rounded(spark):
    values = [1051778.0945, -1051778.0945, 1.0005, 0.0005, -0.0005, 2.5, 1e300, float("inf"), None]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    got = [r.x for r in rows.select("k", T.rounded(F.col("v"), 3).alias("x")).orderBy("k").collect()]
    assert got == [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 3)", [v]).fetchone()[0] for v in values]
    assert got[:2] == [1051778.094, -1051778.094]


def test_workbook_times_equal_sql(spark, tmp_path):
    con, folder = duckdb.connect(), str(tmp_path)
    times = [(0, "signup", 0), (1, "click", 250_000), (2, "view", 1_051_778_094_500), (3, "signup", 1_938_138_209_250), (4, "error", 2_100_255_044_500)]
    rows = ", ".join(f"({i}, TIMESTAMP '2024-01-01' + INTERVAL ({us}) MICROSECOND, {i}, '{kind}', 1.0, '')" for i, kind, us in times)
    con.execute(f"COPY (SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type, value::DOUBLE AS value, props FROM (VALUES {rows}) t(event_id, ts, user_id, event_type, value, props)) TO '{folder}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    want = con.execute(ORACLE_SQL["sink_markers_xlsx"]).fetchall()
    got = QUERIES["sink_markers_xlsx"](spark, folder)
    assert sorted(map(tuple, got.collect())) == sorted(want) and "1051778.094" in {r[2] for r in want}


def test_rows_go_on_in_further_sheets(spark, tmp_path):
    """A sheet of 5 rows and its header; full last sheets, one row more, no row."""
    for n in (0, 5, 6, 17):
        path = str(tmp_path / f"{n}.xlsx")
        rows = spark.range(n).select(F.col("id").alias("k"), F.concat(F.lit("a < b\n"), F.col("id")).alias("note"), F.when(F.col("id") % 3 > 0, F.col("id") * 1e7).alias("x")).repartition(4)
        files.write_xlsx(rows, path, ["k", "note", "x"], ["k"], "Markers", most_rows=6)
        got = [tuple(r) for r in files.read_xlsx(spark, path, most_rows=6).orderBy("row").collect()]
        assert got == [(0, ["k", "note", "x"]), *((k + 1, [str(k), f"a < b\n{k}", repr(k * 1e7) if k % 3 else None]) for k in range(n))]
        with zipfile.ZipFile(path) as z:
            sheets = [x for x in z.namelist() if "worksheets/" in x and "_rels" not in x]
            assert len(sheets) == max(1, -(-n // 5)) and all(z.read(x).count(b"<row>") <= 6 and b">note<" in z.read(x) for x in sheets)
            assert (b'name="Markers 4"' in z.read("xl/workbook.xml")) == (n == 17)
    assert not [p.name for p in tmp_path.iterdir() if not p.name.endswith((".xlsx", ".crc"))]


def test_a_continued_sheet_has_to_be_full(spark, tmp_path):
    path = str(tmp_path / "book.xlsx")
    files.write_xlsx(spark.range(7), path, ["id"], ["id"], "Markers", most_rows=4)
    with pytest.raises(Exception, match="has 4 rows of 5, though another continues it"):
        files.read_xlsx(spark, path, most_rows=5).collect()
