"""Queries of recordings, filters, spectra, peaks, projects and streams; compared with NumPy or round trips in tests."""

from __future__ import annotations

import json
import time

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import intervals as I, led as D, markers as M, signal_blocks as B, windows as W
from ..operators.dsp import Settings
from ..sources import adapters as A, levels, project as P, signal_csv as C, ttl
from ..sources.adapters import RATE_HZ, with_views
from ..sources.shared import fresh_path
from ..streaming import monitor, publishing
from .registry import query
from .sample_queries import FILL

BAND = Settings(True, bandpass=True, low_hz=5.0, high_hz=100.0)
NOTCH = Settings(True, method="notch", frequencies=(60.0,))
SINES = Settings(True, method="regression", frequencies=(60.0,), window_sec=0.5)
BLOCK = 1000
#: Bytes of a recording's window, small enough for several in a small table.
CHUNK_BYTES = 40_000
#: Channel ids in recordings, by the number of the samples' channel from 1.
IDS = (2, 5, 260, 8, 13)


def samples(spark, sf_dir):
    return A.samples(spark, sf_dir)


def recording(spark: SparkSession, sf_dir: str) -> str:
    """Every sample of all channels as metadata-prefixed CSV; cells after the end of a shorter channel are empty."""
    numbers = range(1, len(IDS) + 1)
    rows = samples(spark, sf_dir).groupBy("sample_index").pivot("channel", list(numbers)).agg(F.first("value"))
    wide = rows.select(F.col("sample_index").alias("row"), (F.col("sample_index") * 1000.0).alias("time_us"), *(F.col(str(k)).alias(f"channel_{c}") for k, c in zip(numbers, IDS, strict=True)))
    path = fresh_path(spark, "recording") + ".csv"
    C.write_csv(wide, path, list(IDS), RATE_HZ)
    return path


def one_row(spark, **values) -> DataFrame:
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in values.items()], "name string, value string")


_META = """VALUES ('channels', '[2, 5, 260, 8, 13]'), ('sample_rates', '[1000.0, 1000.0, 1000.0, 1000.0, 1000.0]'), ('header_row', '3'), ('data_column_count', '6'), ('time_unit', '"s"'), ('value_unit', '"uV"')"""


@query("scan_signal_meta", f"SELECT * FROM ({_META}) AS t(name, value)")
def scan_signal_meta(spark, sf_dir):
    return one_row(spark, **C.metadata(spark, recording(spark, sf_dir)))


@query("scan_signal_info", f"SELECT * FROM ({_META}, ('channel_count', '5')) AS t(name, value)")
def scan_signal_info(spark, sf_dir):
    found = C.info(spark, recording(spark, sf_dir))
    return one_row(spark, **{k: v for k, v in found.items() if k not in ("path", "filename")})


@query("scan_signal_units", "SELECT 'value_unit' AS name, '\"uV\"' AS value")
def scan_signal_units(spark, sf_dir):
    return one_row(spark, value_unit=C.metadata(spark, recording(spark, sf_dir))["value_unit"])


@query("scan_data_header", "SELECT CAST(3 AS BIGINT) AS header_row, CAST(6 AS BIGINT) AS columns")
def scan_data_header(spark, sf_dir):
    return spark.createDataFrame([C.data_header(spark, recording(spark, sf_dir))], "header_row long, columns long")


#: The recording's rows: as long as the longest channel, a column a channel.
_REC = "rc AS (SELECT sample_index AS k, " + ", ".join(f"any_value(CASE WHEN channel = {k} THEN CAST(CAST(value AS FLOAT) AS DOUBLE) END) AS channel_{c}" for k, c in enumerate(IDS, 1)) + " FROM samples GROUP BY sample_index)"


@query("scan_signal_frame", with_views("samples", more=_REC, then='SELECT k AS "row", CAST(k * 1000 AS DOUBLE) AS time_us, round(channel_5, 4) AS channel_5, round(channel_260, 4) AS channel_260 FROM rc'))
def scan_signal_frame(spark, sf_dir):
    return C.read(spark, recording(spark, sf_dir), [5, 260]).select("row", "time_us", *(F.round(F.col(c).cast("double"), 4).alias(c) for c in ("channel_5", "channel_260")))


@query("scan_signal_convert", with_views("samples", more=_REC, then=" UNION ALL ".join(f"SELECT CAST({c} AS INTEGER) AS channel, k AS sample_index, CAST(k * 1000 AS DOUBLE) AS time_us, round(channel_{c}, 4) AS value FROM rc" for c in IDS)))
def scan_signal_convert(spark, sf_dir):
    return C.checked(C.to_long(C.read(spark, recording(spark, sf_dir)))).withColumn("value", F.round(F.col("value").cast("double"), 4))


#: The recording's lines with their lengths, and where each begins after the header.
_LINES = "tx AS (SELECT sample_index AS k, " + ", ".join(f"coalesce(any_value(CASE WHEN channel = {k} THEN printf('%.8f', value) END), '') AS c{k}" for k in range(1, len(IDS) + 1)) + " FROM samples GROUP BY sample_index), ll AS (SELECT k, sum(1 + length(concat_ws(',', printf('%.0f', k * 1000.0), " + ", ".join(f"c{k}" for k in range(1, len(IDS) + 1)) + "))) OVER (ORDER BY k) AS upto, 1 + length(concat_ws(',', printf('%.0f', k * 1000.0), " + ", ".join(f"c{k}" for k in range(1, len(IDS) + 1)) + ")) AS size FROM tx)"


@query("scan_chunks_pyarrow", with_views("samples", more=_LINES, then=f"SELECT CAST((upto - size) // {CHUNK_BYTES} AS INTEGER) AS \"window\", count(*) AS n, CAST(min(k) * 1000 AS DOUBLE) AS first_us, CAST(max(k) * 1000 AS DOUBLE) AS last_us FROM ll GROUP BY 1"))
def scan_chunks_pyarrow(spark, sf_dir):
    """Windows of bytes: a line is in the one that it begins in."""
    return C.chunks(spark, recording(spark, sf_dir), CHUNK_BYTES)


@query("scan_chunks_pandas", with_views("samples", more=_REC, then="SELECT k // 500 AS chunk, count(*) AS n, CAST(min(k) * 1000 AS DOUBLE) AS first_us, CAST(max(k) * 1000 AS DOUBLE) AS last_us FROM rc GROUP BY ALL"))
def scan_chunks_pandas(spark, sf_dir):
    """Chunks of 500 rows, whatever the splits."""
    rows = C.read(spark, recording(spark, sf_dir))
    return rows.groupBy(F.floor(F.col("row") / 500).alias("chunk")).agg(F.count("*").alias("n"), F.min("time_us").alias("first_us"), F.max("time_us").alias("last_us"))


def stored(spark, sf_dir) -> str:
    path = fresh_path(spark, "signal-store")
    C.store(C.checked(C.to_long(C.read(spark, recording(spark, sf_dir)))), path)
    return path


_SIZES = "sz AS (SELECT channel, count(*) AS n FROM samples GROUP BY channel), ln AS (SELECT max(n) AS whole FROM sz)"
_IDS = "CASE channel " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(IDS, 1)) + " END"


@query("sink_signal_store", with_views("samples", more=_SIZES, then=f"SELECT {_IDS} AS channel, whole AS n, n AS with_value FROM sz, ln"))
def sink_signal_store(spark, sf_dir):
    return spark.read.parquet(stored(spark, sf_dir)).groupBy("channel").agg(F.count("*").alias("n"), F.count("value").alias("with_value"))


@query("filter_cache_valid", with_views("samples", more=_SIZES, then=f"SELECT {_IDS} AS channel, whole AS n, true AS valid FROM sz, ln UNION ALL SELECT 999, 0, false"))
def filter_cache_valid(spark, sf_dir):
    path = recording(spark, sf_dir)
    store, rows = fresh_path(spark, "signal-store"), C.read(spark, path)
    C.store(C.to_long(rows), store)
    return C.stored_valid(spark, store, [*IDS, 999], rows.count())


@query("sink_ttl_csv", with_views("markers", then="SELECT 'marker_index,local_time(us),local_time,record_time(us),record_time' AS line UNION ALL SELECT k || ',' || 1722384000000000 + us || ',' || strftime(make_timestamp(1722384000000000 + us) + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S.%f') || ',' || us || ',' || printf('%02d:%02d:%02d.%06d', us // 3600000000, us // 60000000 % 60, us // 1000000 % 60, us % 1000000) FROM (SELECT row_number() OVER (ORDER BY seq) AS k, CAST(round_even(time_sec * 1000000, 0) AS BIGINT) AS us FROM markers WHERE kind = 'ttl')"))
def sink_ttl_csv(spark, sf_dir):
    """One CSV file, numbered in the table's order; its lines are read back."""
    us = F.rint(F.col("time_sec") * 1e6).cast("long")
    rows = A.markers(spark, sf_dir).where("kind = 'ttl'").select("seq", (F.lit(1_722_384_000_000_000) + us).alias("local_us"), us.alias("us"))
    path = fresh_path(spark, "ttl") + ".csv"
    ttl.write(M.number_rows(rows, F.floor(F.col("seq") / 100_000), ["seq"], "marker_index"), path)
    return spark.read.option("lineSep", "\r\n").text(path).select(F.col("value").alias("line"))


_KEYED = """ky AS (SELECT event_id, event_type, 'v' || user_id % 50 AS path, CASE WHEN event_id % 4 <> 0 THEN event_id % 3 END AS x, event_id % 4 * 90 AS rotation, event_id % 2 * 30 AS fps, 0 AS a, 100 * (event_id % 2) AS b, greatest(CAST(round_even(event_id % 2 * 30 * 2 / 3.0, 0) AS BIGINT), 1) AS step FROM ev)"""


@query("scan_led_cache", with_views("ev", more=_KEYED, then="SELECT event_id FROM ky a WHERE event_type <> 'view' AND EXISTS (SELECT 1 FROM ky b WHERE event_type = 'view' AND a.path = b.path AND a.x IS NOT DISTINCT FROM b.x AND a.rotation = b.rotation AND a.fps = b.fps AND a.b = b.b)"))
def scan_led_cache(spark, sf_dir):
    """Which requests (all events but views) find a curve made before (the views): by path, region, rotation, rate, range and step."""
    i = F.col("event_id")
    fps = (i % 2 * 30).cast("double")
    roi = F.when(i % 4 != 0, F.struct((i % 3).alias("x"), F.lit(2).alias("y"), F.lit(8).alias("width"), F.lit(8).alias("height")))
    keyed = D.with_cache_key(A.events(spark, sf_dir), path=F.concat(F.lit("v"), (F.col("user_id") % 50).cast("string")), roi=roi, rotation=i % 4 * 90, fps=fps, start=F.lit(0), end=i % 2 * 100)
    return D.cached(keyed.where("event_type <> 'view'"), keyed.where("event_type = 'view'")).select("event_id")


def archive(spark, sf_dir) -> str:
    path = fresh_path(spark, "project") + ".zip"
    m = A.markers(spark, sf_dir)
    P.save_project(spark, path, [f"{sf_dir}/region.parquet", f"{sf_dir}/nation.parquet"], {"data": {"line_noise_hz": 60.0}, "sync": {"mode": "auto", "offset": 99.0}}, m)
    return path


_MIGRATED = '{"show_filtered": false, "bandpass_enabled": false, "bandpass_low_hz": 1.0, "bandpass_high_hz": 100.0, "line_noise_hz": 60.0, "notch_quality": 30.0, "line_noise_method": "notch", "regression_window_seconds": 4.0, "regression_overlap": 0.5, "regression_harmonics": 1, "regression_all_harmonics": false, "line_noise_frequencies_hz": [60.0]}'


@query("scan_project", f"SELECT 'version' AS name, '3' AS value UNION ALL SELECT 'settings', '{_MIGRATED}'")
def scan_project(spark, sf_dir):
    manifest, state = P.load(spark, archive(spark, sf_dir))
    return one_row(spark, version=manifest["version"], settings=state["data"]["lfp_filter_settings"])


@query("sink_project", "SELECT true AS written")
def sink_project(spark, sf_dir):
    return spark.read.format("binaryFile").load(archive(spark, sf_dir)).select((F.col("length") > 0).alias("written"))


_PAIR = "tt AS (SELECT min(time_sec) AS t, arg_min(marker_id, (time_sec, seq)) AS id FROM markers WHERE kind = 'ttl'), vv AS (SELECT min(time_sec) AS t, arg_min(marker_id, (time_sec, seq)) AS id FROM markers WHERE kind = 'led_on')"


@query("scan_project_restore", with_views("markers", more=_PAIR, then="SELECT (SELECT count(*) FROM markers) AS markers, 'notch' AS method, tt.id AS ttl_id, vv.id AS video_id, vv.t - tt.t AS offset_sec FROM tt, vv"))
def scan_project_restore(spark, sf_dir):
    """Sources checked, markers and settings taken over; the stored offset isn't trusted and follows from the markers."""
    markers, settings, pair = P.restore(spark, archive(spark, sf_dir))
    n = markers.agg(F.count("*").alias("markers"))
    return n.crossJoin(pair).select("markers", F.lit(settings["line_noise_method"]).alias("method"), "ttl_id", "video_id", "offset_sec")


@query("join_source_fingerprint")
def join_source_fingerprint(spark, sf_dir):
    """The sources of a project that was saved, as they are now, against the fingerprints in it."""
    manifest, _ = P.load(spark, archive(spark, sf_dir))
    stored = spark.createDataFrame([(p, x["sample_sha256"]) for p, x in manifest["sources"].items()], "path string, sample_sha256 string")
    return P.check_sources(P.fingerprints(spark, list(manifest["sources"])), stored).select("sample_sha256")


@query("fn_fingerprint")
def fn_fingerprint(spark, sf_dir):
    return P.fingerprints(spark, [f"{sf_dir}/region.parquet", f"{sf_dir}/nation.parquet", f"{sf_dir}/events.parquet"]).select("size", "sample_sha256")


@query("fn_cache_digest", with_views("ev", then="""SELECT event_id, substr(sha256('{"version":1,"source":' || user_id || '}'), 1, 24) AS digest FROM ev"""))
def fn_cache_digest(spark, sf_dir):
    body = F.to_json(F.struct(F.lit(1).alias("version"), F.col("user_id").alias("source")))
    return A.events(spark, sf_dir).select("event_id", F.substring(F.sha2(body, 256), 1, 24).alias("digest"))


@query("fn_validate_project", with_views("markers", then="SELECT seq, CASE WHEN seq % 100 = 0 THEN 'kind' WHEN seq % 101 = 0 THEN 'domain' WHEN seq % 103 = 0 THEN 'time' WHEN seq % 107 = 0 OR domain = 'record' AND seq % 4 = 0 THEN 'frame' ELSE 'id' END AS broken FROM markers WHERE seq % 100 = 0 OR seq % 101 = 0 OR seq % 103 = 0 OR seq % 107 = 0 OR domain = 'record' AND seq % 4 = 0 OR seq % 109 = 0"))
def fn_validate_project(spark, sf_dir):
    """Markers with unknown kinds, no domain, times that aren't finite, wrong frames and empty ids."""
    n = F.col("seq")
    m = A.markers(spark, sf_dir)
    frame = F.when(n % 107 == 0, -1).when((F.col("domain") == "record") & (n % 4 == 0), 5).otherwise(F.col("frame_index"))
    bad = m.withColumns({"frame_index": frame, "kind": F.when(n % 100 == 0, "odd").otherwise(F.col("kind")), "domain": F.when(n % 101 != 0, F.col("domain")), "time_sec": F.when(n % 103 == 0, float("nan")).otherwise(F.col("time_sec")), "marker_id": F.when(n % 109 == 0, "").otherwise(F.col("marker_id"))})
    return P.bad_markers(bad).select("seq", "broken")


@query("sp_prepare", with_views("samples_dirty", more=FILL, then="SELECT channel, sample_index, time_us, round(CASE WHEN ai IS NULL AND bi IS NULL THEN 0 WHEN ai IS NULL THEN bv WHEN bi IS NULL OR ai = bi THEN av ELSE av + (bv - av) * (sample_index - ai) / (bi - ai) END, 9) AS value FROM g"))
def sp_prepare(spark, sf_dir):
    return B.filtered(A.samples_dirty(spark, sf_dir), None, RATE_HZ, BLOCK).withColumn("value", F.round("value", 9))


@query("sp_bandpass")
def sp_bandpass(spark, sf_dir):
    return B.filtered(samples(spark, sf_dir), BAND, RATE_HZ, BLOCK)


@query("sp_notch")
def sp_notch(spark, sf_dir):
    return B.filtered(samples(spark, sf_dir), NOTCH, RATE_HZ, BLOCK)


@query("sp_regression")
def sp_regression(spark, sf_dir):
    return B.regression(samples(spark, sf_dir), SINES, RATE_HZ)


@query("sp_segment_filtered")
def sp_segment_filtered(spark, sf_dir):
    rows = B.filtered(samples(spark, sf_dir), BAND, RATE_HZ, BLOCK)
    return rows.where(F.col("time_us").between(86_400e6, 5 * 86_400e6))


@query("sp_overview_filtered")
def sp_overview_filtered(spark, sf_dir):
    return B.overview_filtered(samples(spark, sf_dir), Settings(True, bandpass=True, low_hz=1.0, high_hz=20.0), RATE_HZ, 7, BLOCK)


@query("sp_coarse")
def sp_coarse(spark, sf_dir):
    """Filtered at full resolution, kept as levels, read from the one for the step."""
    path = fresh_path(spark, "filtered-levels")
    levels.write_levels(B.filtered(samples(spark, sf_dir), BAND, RATE_HZ, BLOCK), path, (9, 90))
    return levels.read_level(spark, path, 9).withColumn("value", F.col("value").cast("float"))


@query("sp_plot_segment")
def sp_plot_segment(spark, sf_dir):
    """Filtered at full resolution, then every 5th row counted from the segment's left end."""
    left = 200
    rows = B.filtered(samples(spark, sf_dir), BAND, RATE_HZ, BLOCK)
    return rows.where((F.col("sample_index") >= left) & (F.col("sample_index") < 1200) & ((F.col("sample_index") - left) % 5 == 0))


@query("sp_display_segment")
def sp_display_segment(spark, sf_dir):
    rows = B.filtered(samples(spark, sf_dir), NOTCH, RATE_HZ, BLOCK).where(F.col("sample_index") % 4 == 0)
    return rows.withColumn("point", F.floor(F.col("sample_index") / 4))


@query("sp_export_waveform")
def sp_export_waveform(spark, sf_dir):
    """At most 200,000 points a channel: a stride of ceil(n / 200,000) over the prepared values."""
    rows = B.filtered(samples(spark, sf_dir), BAND, RATE_HZ, BLOCK)
    steps = samples(spark, sf_dir).groupBy("channel").agg(F.ceil(F.count("*") / 200_000).alias("step"))
    return rows.join(F.broadcast(steps), "channel").where(F.col("sample_index") % F.col("step") == 0).select("channel", "sample_index", (F.col("time_us") / 1e6).alias("record_sec"), "value")


@query("sp_psd")
def sp_psd(spark, sf_dir):
    return B.psd(samples(spark, sf_dir), RATE_HZ)


#: Half-overlapping segments of 256 samples (all, where there are fewer) and their discrete Fourier transform, written out.
_DFT = """sn AS (SELECT channel, count(*) AS n, least(count(*), 256) AS z, least(count(*), 256) - least(count(*), 256) // 2 AS hop FROM samples GROUP BY channel HAVING count(*) >= 8),
sg AS (SELECT s.channel, z, k, sample_index - k * hop AS j, value FROM samples s JOIN sn ON s.channel = sn.channel, LATERAL (SELECT unnest(range(greatest(sample_index // hop - 2, 0), sample_index // hop + 1)) AS k) WHERE sample_index - k * hop < z AND k * hop + z <= n),
dm AS (SELECT channel, z, k, j, (value - avg(value) OVER (PARTITION BY channel, k)) * (0.5 - 0.5 * cos(2 * pi() * j / z)) AS x FROM sg),
ft AS (SELECT channel, z, k, f, sum(x * cos(2 * pi() * f * j / z)) AS re, sum(x * sin(2 * pi() * f * j / z)) AS im FROM dm, range(0, 129) AS t(f) WHERE f <= z // 2 GROUP BY ALL)"""


@query("agg_welch_mean", with_views("samples", more=_DFT, then="SELECT channel, f AS bin, round(f * (1000 / z), 9) AS freq, round(avg((re * re + im * im) / (375.0 * z) * CASE WHEN f = 0 OR 2 * f = z THEN 1 ELSE 2 END), 6) AS power FROM ft GROUP BY channel, f, z"))
def agg_welch_mean(spark, sf_dir):
    return B.psd(samples(spark, sf_dir), RATE_HZ, most=256).withColumn("power", F.round("power", 6)).withColumn("freq", F.round("freq", 9))


@query("sp_spectrogram")
def sp_spectrogram(spark, sf_dir):
    return B.spectrogram(samples(spark, sf_dir), RATE_HZ)


@query("sp_find_peaks")
def sp_find_peaks(spark, sf_dir):
    return B.find_peaks(samples(spark, sf_dir), RATE_HZ, height_sigma=2.0, prominence_sigma=1.5, distance_sec=0.01, context_sec=0.05, block=BLOCK)


@query("topk_peak_nms")
def topk_peak_nms(spark, sf_dir):
    tops = W.local_extrema(samples(spark, sf_dir), 60.0, -1.0).where("is_high")
    return B.nms(tops.select("channel", "sample_index", "value", F.col("value").alias("prominence"), F.lit(False).alias("negative")), 8)


@query("topk_peak_distance")
def topk_peak_distance(spark, sf_dir):
    return B.distant(W.local_extrema(samples(spark, sf_dir), 60.0, -1.0).where("is_high"), 8)


@query("sp_peak_display")
def sp_peak_display(spark, sf_dir):
    """High values, evenly thinned to a quarter of a channel's 2000 points, and the samples around them, each interval
    evenly thinned to its share of the points that are left. A sample may come as both, as in the reference."""
    budget = 2000
    rows = samples(spark, sf_dir)
    tops = rows.where("value > 100")
    markers = W.even_sample(tops, budget // 4)
    left_over = tops.groupBy("channel").agg((F.lit(budget) - F.least(F.count("*"), F.lit(budget // 4))).alias("budget"))
    intervals = I.peak_intervals(tops.select("channel", (F.col("time_us") / 1e6).alias("time_sec")), 300.0, 3000.0)
    spans = W.allocate_points(intervals.join(F.broadcast(left_over), "channel"), F.col("budget"))
    # an interval is at most 3000 s long: rows and intervals meet on 3000 s buckets
    k = F.explode(F.sequence(F.floor(F.col("left") / 3000), F.floor(F.col("right") / 3000)))
    inside = rows.withColumn("k", F.floor(F.col("time_us") / 3000e6)).join(spans.withColumn("k", k), ["channel", "k"]).where((F.col("time_us") / 1e6).between(F.col("left"), F.col("right")))
    names = ["channel", "sample_index", "value"]
    return W.even_sample(inside, F.col("points"), ("channel", "left")).select(*names).unionByName(markers.select(*names))


def _stream(spark, sf_dir) -> tuple[DataFrame, str]:
    path = fresh_path(spark, "stream-input")
    rows = A.samples_dirty(spark, sf_dir).withColumn("ts", F.timestamp_micros(F.col("time_us").cast("long")))
    rows.repartition(2, F.floor(F.col("sample_index") / 1_000_000)).write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path), path


def _drained(spark, stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs the stream over what is there and returns the rows it wrote."""
    out = fresh_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", fresh_path(spark, name + "-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


_STREAMED = "gp AS (SELECT *, time_us - lag(time_us) OVER (PARTITION BY channel ORDER BY sample_index) AS g FROM samples_dirty)"


@query("st_carry_last", with_views("samples_dirty", more=_STREAMED, then="SELECT channel, count(*) AS n, count_if(g = 0) AS duplicates, count_if(g <> 0 AND g <> 1000) AS discontinuities, arg_max(time_us, sample_index) AS last_us FROM gp GROUP BY channel"))
def st_carry_last(spark, sf_dir):
    stream, _ = _stream(spark, sf_dir)
    path = fresh_path(spark, "gaps")
    monitor.follow_gaps(stream, path, fresh_path(spark, "gaps-state"), 1000.0).awaitTermination()
    return monitor.read_gaps(spark, path, 1000.0).drop("backwards")


@query("st_monotonic", with_views("samples_dirty", then="SELECT channel, count(*) AS n FROM samples_dirty GROUP BY channel"))
def st_monotonic(spark, sf_dir):
    stream, _ = _stream(spark, sf_dir)
    path = fresh_path(spark, "monotonic")
    monitor.follow_gaps(stream, path, fresh_path(spark, "monotonic-state"), 1000.0, strict=True).awaitTermination()
    return monitor.read_gaps(spark, path, 1000.0).select("channel", "n")


@query("st_incremental_publish", with_views("samples_dirty", then="SELECT channel, count(*) AS n FROM samples_dirty WHERE sample_index % 5 = 0 GROUP BY channel"))
def st_incremental_publish(spark, sf_dir):
    """Ranges of a filtered channel, those nearest to sample 700 first; all parts are read when the last one is ready."""
    path = fresh_path(spark, "published")
    for _ in publishing.publish(A.samples_dirty(spark, sf_dir), BAND, RATE_HZ, 5, path, wanted=700, size=BLOCK):
        pass
    return publishing.read_ready(spark, path).groupBy("channel").agg(F.count("*").alias("n"))


@query("st_tumbling", with_views("samples_dirty", then="SELECT channel, CAST(floor(time_us / 3600e6) AS BIGINT) AS hour, count(*) AS n, round(sum(value), 6) AS total FROM samples_dirty GROUP BY ALL"))
def st_tumbling(spark, sf_dir):
    """A stream in windows of an hour of event time; each window's last update counts."""
    stream, _ = _stream(spark, sf_dir)
    found = _drained(spark, monitor.tumbling(stream, "1 hour", "40 days"), "update", "tumbling")
    last = found.groupBy("channel", "window").agg(F.max_by(F.struct("n", "total"), "batch").alias("s"))
    return last.select("channel", F.floor(F.unix_micros("window.start") / 3_600_000_000).alias("hour"), "s.n", F.round("s.total", 6).alias("total"))


@query("st_progress", with_views("samples_dirty", then="SELECT CAST(0 AS DOUBLE) AS first_fraction, CAST(1 AS DOUBLE) AS last_fraction, true AS rising"))
def st_progress(spark, sf_dir):
    """The fractions that a stream over the whole table reports."""
    stream, path = _stream(spark, sf_dir)
    seen: list[float] = []
    listener = monitor.Progress(spark.read.parquet(path).count(), seen.append)
    spark.streams.addListener(listener)
    try:
        _drained(spark, stream.select("channel"), "append", "progress")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        for _ in range(100):  # the last event comes through its own bus
            if seen[-1:] == [1.0]:
                break
            time.sleep(0.05)
    finally:
        spark.streams.removeListener(listener)
    return spark.createDataFrame([(seen[0], seen[-1], seen == sorted(seen))], "first_fraction double, last_fraction double, rising boolean")


@query("st_cancel", "SELECT true AS cancelled, false AS written")
def st_cancel(spark, sf_dir):
    """A write that is cancelled while it runs leaves no table."""
    out, tag, ended = fresh_path(spark, "cancelled"), "cancelled-" + fresh_path(spark, "")[-8:], []
    slow = A.events(spark, sf_dir).repartition(8).mapInArrow(monitor.slowly, "event_id long")

    def job() -> None:
        try:
            slow.write.parquet(out)
        except Exception as e:  # how Spark tells a cancelled job
            ended.append(str(e))

    thread = InheritableThread(monitor.cancellable(spark, tag, job), session=spark)
    thread.start()
    while thread.is_alive():
        time.sleep(0.2)
        spark.sparkContext.cancelJobsWithTag(tag)
    thread.join()
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out + "/_SUCCESS")
    done = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.createDataFrame([(bool(ended), done)], "cancelled boolean, written boolean")
