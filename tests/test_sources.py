import math

import pytest
from pyspark.sql import functions as F

from wavemark.functions import settings as S, text as X
from wavemark.operators import intervals as I, markers as M, samples as O, windows as W
from wavemark.sources import project as P, signal_csv as C, ttl

CHANNELS = (2, 5, 260)


def recording(tmp_path, rate=10, seconds=2, missing=(), duplicate=(), jump_after=()):
    """Rows of a recording as text: sines, with empty cells, repeated times and jumps where asked."""
    lines = ["Channels,2,5,260", f"Sample Rate[Hz],{rate},{rate},{rate}", "Unit,uV,uV,uV", "Time[us],Channel 2,Channel 5,Channel 260"]
    shift, before = 0, 0
    for i in range(rate * seconds):
        t = before if i in duplicate and i else round(i * 1e6 / rate) + shift
        cells = ["" if i in missing else f"{math.sin(2 * math.pi * (k + 1) * i / rate):.8f}" for k in range(3)]
        lines.append(",".join([str(t), *cells]))
        before = t
        shift += 2_000_000 * (i in jump_after)
    path = tmp_path / "signal.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_metadata_and_read(spark, tmp_path):
    path = recording(tmp_path, missing=(2,))
    m = C.metadata(spark, path)
    assert m == {"channels": [2, 5, 260], "sample_rates": [10.0] * 3, "header_row": 3, "data_column_count": 4, "time_unit": "s", "value_unit": "uV"}
    rows = C.read(spark, path, [260]).orderBy("row").collect()
    assert len(rows) == 20 and rows[0].row == 0 and rows[1].time_us == 100_000.0
    assert rows[2].channel_260 is None and rows[3].channel_260 == pytest.approx(math.sin(2 * math.pi * 3 * 3 / 10), abs=1e-6)
    assert C.read(spark, path).dtypes[1:] == [("time_us", "double"), ("channel_2", "float"), ("channel_5", "float"), ("channel_260", "float")]
    with pytest.raises(ValueError):
        C.read(spark, path, [3])


def test_check_counts_duplicates_and_what_follows_them(spark, tmp_path):
    long = C.to_long(C.read(spark, recording(tmp_path, missing=(2,), duplicate=(5,), jump_after=(8,))))
    r = {x.channel: x for x in O.anomaly_counts(long, 10.0).collect()}[2]
    assert (r.n, r.duplicates, r.discontinuities) == (20, 1, 2)
    assert sum(x.missing_value for x in O.missing_counts(long).collect()) == 3


def test_backwards_times_are_an_error(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 5.0, 1.0), (1, 2, 4.0, 1.0)], "channel int, sample_index long, time_us double, value double")
    with pytest.raises(Exception, match="backwards"):
        C.checked(rows).collect()
    assert C.checked(rows.where("sample_index < 2")).count() == 2


def test_store_round_trip(spark, tmp_path):
    long = C.checked(C.to_long(C.read(spark, recording(tmp_path))))
    path = str(tmp_path / "store")
    C.store(long, path)
    assert sorted(spark.read.parquet(path).select("channel", "sample_index", "time_us", "value").collect()) == sorted(long.collect())
    got = {r.channel: r.valid for r in C.stored_valid(spark, path, [2, 7], 20).collect()}
    assert got == {2: True, 7: False}


def test_ttl_names_and_numbers(spark, tmp_path):
    assert ttl.columns_of(["x_time(us)", "Record_Time(us)"]) == ("x_time(us)", "Record_Time(us)")
    assert ttl.columns_of(["record_time(us)", "b"]) == ("record_time(us)", "record_time(us)")
    assert ttl.columns_of(["a", "b"]) == ("a", "b")
    (tmp_path / "ttl.csv").write_text("local_time(us),record_time(us)\n1722384000000000,2500000\nx,1\n1,\n-1.9,-0.5\n")
    rows = ttl.read(spark, str(tmp_path / "ttl.csv")).collect()
    assert [(r.local_time_us, r.record_time) for r in rows] == [(1722384000000000, 2500000), (-1, 0)]
    assert rows[0].record_seconds == 2 and rows[0].record_microseconds == 500_000


def test_project_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/p.zip"
    P.save(spark, path, {"version": 3}, {"data": {"line_noise_hz": 50.0}})
    manifest, state = P.load(spark, path)
    s = state["data"]["lfp_filter_settings"]
    assert manifest == {"version": 3} and "line_noise_hz" not in state["data"]
    assert (s["line_noise_hz"], s["line_noise_frequencies_hz"], s["line_noise_method"]) == (50.0, [50.0], "notch")
    P.save(spark, path, {"version": 2}, {})
    with pytest.raises(ValueError):
        P.load(spark, path)


def test_fingerprint_reads_three_places():
    asked = []
    a = bytes(3 << 20)
    b = bytearray(a)
    b[(1 << 20) + 5] = 1  # inside the middle sample

    def read(data):
        return lambda at, n: asked.append((at, n)) or bytes(data[at : at + n])

    assert P.fingerprint_of(len(a), read(a)) != P.fingerprint_of(len(b), read(b)) and len(P.fingerprint_of(0, read(b""))) == 64
    assert asked[:3] == [(0, 1 << 20), (1 << 20, 1 << 20), (2 << 20, 1 << 20)]


def test_settings(spark):
    def each(*texts, legacy=None):
        rows = spark.createDataFrame([(k, t, legacy) for k, t in enumerate(texts)], "k int, t string, legacy double")
        return rows.select("k", S.migrate(F.col("t"), F.col("legacy")).alias("s"))

    s = [r.s for r in each("{}", None, '{"regression_harmonics": 2}', '{"line_noise_frequencies_hz": null, "line_noise_hz": 60}', '{"line_noise_frequencies_hz": [50, 60]}', '{"line_noise_hz": null}').orderBy("k").collect()]
    assert [x.line_noise_method for x in s] == ["none", "none", "none", "notch", "notch", "none"]
    assert s[2].regression_all_harmonics and not s[0].regression_all_harmonics
    assert [(x.line_noise_hz, x.line_noise_frequencies_hz) for x in s[3:]] == [(60.0, [60.0]), (50.0, [50.0, 60.0]), (None, [])]
    old = [r.s for r in each("{}", '{"line_noise_hz": 60}', legacy=50.0).orderBy("k").collect()]
    assert [(x.line_noise_hz, x.line_noise_method) for x in old] == [(50.0, "notch"), (60.0, "notch")]
    broken = {'{"notch_quality": 0}': ["quality"], '{"line_noise_method": "x", "regression_overlap": 1}': ["method", "overlap"], '{"line_noise_frequencies_hz": [0]}': ["frequencies", "frequency"], '{"regression_all_harmonics": 3}': ["all harmonics"], '{"show_filtered": true, "line_noise_method": "notch"}': ["frequencies"]}
    assert [r.p for r in each(*broken).orderBy("k").select(S.problems(F.col("s")).alias("p")).collect()] == list(broken.values())
    shown = each('{"show_filtered": true, "line_noise_hz": 60}', '{"line_noise_hz": 60}').orderBy("k").select(S.describe(F.col("s")).alias("d")).collect()
    assert [r.d for r in shown] == ["Filtered: bandpass off (low 1 Hz, high 100 Hz), notch 60 Hz (Q=30)", "Raw"]
    form = S.from_controls(filtered=F.lit(True), bandpass=F.lit(False), low_hz=F.lit(1.0), high_hz=F.lit(2.0), method=F.lit("notch"), frequency_text=F.lit(" "), quality=F.lit(1.0), window_sec=F.lit(1.0), overlap_percent=F.lit(0), all_harmonics=F.lit(False))
    with pytest.raises(Exception, match="a frequency is needed"):
        spark.range(1).select(form.alias("s")).collect()


def test_status_lines(spark):
    one = spark.createDataFrame([(2, "opencl", 0.25)], "n int, backend string, t double")
    line = X.led_status({"event_count": F.col("n"), "brightness_backend": F.col("backend"), "scan_elapsed_sec": F.col("t"), "threshold": F.lit(0.0123456), "scan_end_frame": F.lit(900), "points_count": F.lit(46)})
    got = one.select(line.alias("line")).select("line", X.short_status(F.col("line")).alias("short")).first()
    assert got.line == "LED detection: Frame delta | 2 intervals | scan frames=0-900 | coarse step=20 frames | refine window=1.0s | points=46 | TTL-guided event limit | requested=2 | threshold=0.012346 | duration=0.6-1.5s target=1.0s | event pairs=2 | scan=0.2s detect=0.0s | brightness=OpenCL | selected=auto | batch=fixed | capacity=0 | batches=0 | max_batch=0"
    assert got.short == ["LED detection: Frame delta", "2 intervals", "scan frames=0-900", "points=46", "requested=2", "threshold=0.012346", "duration=0.6-1.5s target=1.0s", "scan=0.2s detect=0.0s"]
    assert one.select(X.short_status(F.lit("")).alias("s")).first().s == []


def marker_rows(spark, rows):
    return spark.createDataFrame([(f"m{k}", k, kind, "manual", domain, t, None, "", 1) for k, (kind, domain, t) in enumerate(rows)], "marker_id string, seq long, kind string, source string, domain string, time_sec double, frame_index long, note string, user_id int")


def test_pairing_and_sync(spark):
    m = marker_rows(spark, [("action_start", "video", 1.0), ("action_start", "video", 5.0), ("action_end", "video", 4.0), ("action_end", "video", 8.0), ("action_end", "video", 9.0), ("ttl", "record", 2.5), ("led_on", "video", 5.0)])
    assert [(r.start_marker_id, r.end_marker_id) for r in M.pair_intervals(m, "action_start", "action_end").collect()] == [("m1", "m3")]
    one = M.sync(m).first()
    assert (one.ttl_id, one.video_id, one.offset_sec) == ("m5", "m6", 2.5)
    got = {r.event_type: (r.start_sec, r.end_sec) for r in M.event_intervals(m, M.sync(m)).collect()}
    assert got == {"ttl": (2.5, None), "action": (2.5, 5.5)}
    assert M.event_intervals(m.where("kind <> 'led_on'"), M.sync(m.where("kind <> 'led_on'"))).count() == 0
    bad = M.interval_warning(m).first()
    assert (bad.number, bad.problem) == (3, "action_end isn't after #2")


def test_reorder_moves_among_video_rows(spark):
    m = marker_rows(spark, [("led_on", "video", 1.0), ("ttl", "record", 1.0), ("led_off", "video", 2.0), ("led_on", "video", 3.0)])
    got = [r.marker_id for r in M.reorder(m, "m3", 1, "user_id").orderBy("seq").collect()]
    assert got == ["m3", "m1", "m0", "m2"]


def test_peak_intervals_and_points(spark):
    t = spark.createDataFrame([(1, x) for x in (1.0, 1.5, 12.0, float("nan"))], "channel int, time_sec double")
    assert sorted((r.left, r.right) for r in I.peak_intervals(t).collect()) == [(0.0, 2.5), (11.0, 13.0)]
    iv = spark.createDataFrame([(1, 0.0, 1.0), (1, 2.0, 5.0)], "channel int, left double, right double")
    assert sum(r.points for r in W.allocate_points(iv, 101).collect()) == 101
    long = spark.createDataFrame([(1, float(x)) for x in range(100)], "channel int, time_sec double")
    assert max(r.right - r.left for r in I.peak_intervals(long).collect()) <= 30


def test_row_numbers_over_buckets(spark):
    df = spark.range(1000).withColumn("v", F.col("id") * 7 % 1000)
    got = M.number_rows(df, F.floor(F.col("v") / 64), ["v"]).collect()
    assert all(r.number == r.v + 1 for r in got)
