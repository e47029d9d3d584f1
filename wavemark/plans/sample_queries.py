"""Queries over sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import time_math as T
from ..operators import images as I, samples as S, signal_blocks as B, windows as W
from ..sources import adapters as A, files, levels
from ..sources.adapters import RATE_HZ, with_views
from ..sources.shared import fresh_path
from .registry import query

DAY = 86_400e6
LO, HI = 5 * DAY, 12 * DAY
_V = lambda then, more="": with_views("samples", then=then, more=more)
_D = lambda then, more="": with_views("samples_dirty", then=then, more=more)
_OK = "value IS NOT NULL AND isfinite(value)"


@query("scan_csv_preview", "SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 8")
def scan_csv_preview(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("event_id").select("event_id", "event_type", "value").limit(8)


@query("scan_coarse", _V("SELECT channel, sample_index, time_us, value FROM samples WHERE sample_index % 7 = 0"))
def scan_coarse(spark, sf_dir):
    """From stored levels: a read of every 7th row opens the files of that level alone."""
    path = fresh_path(spark, "levels")
    levels.write_levels(A.samples(spark, sf_dir), path, (7, 70))
    return levels.read_level(spark, path, 7)


@query("proj_channel", _V("SELECT channel, sample_index, value FROM samples WHERE channel = 2"))
def proj_channel(spark, sf_dir):
    return S.channel(A.samples(spark, sf_dir), 2).select("channel", "sample_index", "value")


@query("proj_values_only", _V("SELECT channel, arg_min(value, sample_index) AS first_value, arg_max(value, sample_index) AS last_value FROM samples GROUP BY channel"))
def proj_values_only(spark, sf_dir):
    return S.edge_values(A.samples(spark, sf_dir))


@query("proj_record_time", _V("SELECT channel, sample_index, time_us / 1e6 AS record_sec FROM samples"))
def proj_record_time(spark, sf_dir):
    return A.samples(spark, sf_dir).select("channel", "sample_index", (F.col("time_us") / 1e6).alias("record_sec"))


@query("proj_waveform_series", _V("SELECT channel, sample_index, time_us / 1e6 - 100 AS plot_sec, value FROM (SELECT *, count(*) OVER (PARTITION BY channel) AS n FROM samples) WHERE n <= 10 OR sample_index % 10 = 0"))
def proj_waveform_series(spark, sf_dir):
    return S.waveform(A.samples(spark, sf_dir), 10, 100.0)


@query("filter_time_range_idx", _V(f"SELECT channel, count_if(time_us < {LO}) AS left_index, count_if(time_us <= {HI}) AS right_index FROM samples GROUP BY channel"))
def filter_time_range_idx(spark, sf_dir):
    return S.segment_bounds(A.samples(spark, sf_dir), LO, HI)


@query("filter_segment", _V(f"SELECT channel, sample_index, time_us, value FROM samples WHERE time_us BETWEEN {LO} AND {HI}"))
def filter_segment(spark, sf_dir):
    return S.time_range(A.samples(spark, sf_dir), LO, HI).select("channel", "sample_index", "time_us", "value")


@query("filter_segment_mask", _V("SELECT channel, sample_index, time_us / 1e6 AS record_sec, value FROM samples WHERE time_us / 1e6 BETWEEN 432000 AND 1036800"))
def filter_segment_mask(spark, sf_dir):
    return S.segment_mask(A.samples(spark, sf_dir), 1036800.0, 432000.0).select("channel", "sample_index", "record_sec", "value")


@query("filter_bounds", _V("SELECT channel, min(time_us) AS first_us, max(time_us) AS last_us FROM samples GROUP BY channel"))
def filter_bounds(spark, sf_dir):
    return S.bounds(A.samples(spark, sf_dir))


@query("filter_index_clamp", _V("SELECT channel, sample_index, value FROM samples WHERE sample_index >= 0 AND sample_index < 25"))
def filter_index_clamp(spark, sf_dir):
    return S.index_range(A.samples(spark, sf_dir), -10, 25).select("channel", "sample_index", "value")


@query("filter_stride", _V("SELECT channel, sample_index, value FROM samples WHERE sample_index >= 5 AND (sample_index - 5) % 9 = 0"))
def filter_stride(spark, sf_dir):
    return S.stride(A.samples(spark, sf_dir), 9, 5).select("channel", "sample_index", "value")


@query("filter_overview", _V("SELECT channel, sample_index, value, step FROM samples JOIN (SELECT channel, greatest(count(*) // 100, 1) AS step FROM samples GROUP BY channel) USING (channel) WHERE sample_index % step = 0"))
def filter_overview(spark, sf_dir):
    return S.overview(A.samples(spark, sf_dir), 100).select("channel", "sample_index", "value", "step")


@query("filter_finite", _D(f"SELECT channel, sample_index, value FROM samples_dirty WHERE {_OK} AND isfinite(time_us)"))
def filter_finite(spark, sf_dir):
    return A.samples_dirty(spark, sf_dir).where(S.finite(F.col("value")) & S.finite(F.col("time_us"))).select("channel", "sample_index", "value")


@query("filter_frequency_range", with_views("vectors", then="SELECT vec_id, k - 1 AS bin, (k - 1) * CAST(7.8125 AS DOUBLE) AS freq, v[k] AS power FROM vectors, range(1, 65) AS t(k) WHERE (k - 1) * CAST(7.8125 AS DOUBLE) BETWEEN 50 AND 200"))
def filter_frequency_range(spark, sf_dir):
    bins = A.vectors(spark, sf_dir).select("vec_id", F.posexplode("v").alias("bin", "power"))
    return bins.select("vec_id", F.col("bin").cast("long").alias("bin"), (F.col("bin") * 7.8125).alias("freq"), "power").where(F.col("freq").between(50, 200))


@query("filter_visible_range", _V(f"SELECT channel, count(*) AS n, min(sample_index) AS first_index FROM samples WHERE time_us BETWEEN {LO} AND {LO + DAY} GROUP BY channel"))
def filter_visible_range(spark, sf_dir):
    return S.time_range(A.samples(spark, sf_dir), LO, LO + DAY).groupBy("channel").agg(F.count("*").alias("n"), F.min("sample_index").alias("first_index"))


@query("filter_playback_thin", _V("SELECT channel, sample_index FROM (SELECT *, max(sample_index) OVER (PARTITION BY channel) AS last_index FROM samples) WHERE sample_index <= 0 OR sample_index >= last_index OR sample_index % 15 = 0"))
def filter_playback_thin(spark, sf_dir):
    rows = A.samples(spark, sf_dir)
    rows = rows.join(F.broadcast(rows.groupBy("channel").agg(F.max("sample_index").alias("last_index"))), "channel")  # a row a channel
    return rows.where((F.col("sample_index") <= 0) | (F.col("sample_index") >= F.col("last_index")) | (F.col("sample_index") % 15 == 0)).select("channel", "sample_index")


@query("join_sample_rate", _V("SELECT channel, CASE channel WHEN 1 THEN CAST(1000 AS DOUBLE) WHEN 2 THEN 500 WHEN 3 THEN 1000 ELSE r END AS rate_hz FROM (SELECT channel, 1e6 / median(d) AS r FROM (SELECT channel, time_us - lag(time_us) OVER (PARTITION BY channel ORDER BY sample_index) AS d FROM samples) WHERE d > 0 GROUP BY channel)"))
def join_sample_rate(spark, sf_dir):
    return S.sample_rates(A.samples(spark, sf_dir), [1000.0, 0.0, 500.0], [1, 2, 3])


@query("agg_sample_count", _V("SELECT channel, count(*) AS n FROM samples GROUP BY channel"))
def agg_sample_count(spark, sf_dir):
    return S.counts(A.samples(spark, sf_dir))


_CHUNKS = f"chunks AS (SELECT channel, sample_index // 250 AS chunk, count(CASE WHEN {_OK} THEN value END) AS n, avg(CASE WHEN {_OK} THEN value END) AS mean, var_pop(CASE WHEN {_OK} THEN value END) * count(CASE WHEN {_OK} THEN value END) AS m2 FROM samples_dirty GROUP BY ALL)"


@query("agg_chunk_stats", _D("SELECT channel, chunk, n, round(mean, 6) AS mean, round(m2, 4) AS m2 FROM chunks", _CHUNKS))
def agg_chunk_stats(spark, sf_dir):
    return S.chunk_stats(A.samples_dirty(spark, sf_dir), 250).select("channel", "chunk", "n", F.round("mean", 6).alias("mean"), F.round("m2", 4).alias("m2"))


@query("agg_merge_stats", _D(f"SELECT channel, count(value) AS n, round(avg(value), 6) AS mean, round(var_pop(value) * count(value), 3) AS m2 FROM samples_dirty WHERE {_OK} GROUP BY channel"))
def agg_merge_stats(spark, sf_dir):
    return S.merge_stats(S.chunk_stats(A.samples_dirty(spark, sf_dir), 250)).select("channel", "n", F.round("mean", 6).alias("mean"), F.round("m2", 3).alias("m2"))


@query("agg_global_mean_std", _D(f"SELECT channel, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM samples_dirty WHERE {_OK} GROUP BY channel"))
def agg_global_mean_std(spark, sf_dir):
    return S.mean_std(A.samples_dirty(spark, sf_dir)).select("channel", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("agg_median_rate", _V("SELECT channel, 1e6 / median(d) AS rate_hz FROM (SELECT channel, time_us - lag(time_us) OVER (PARTITION BY channel ORDER BY sample_index) AS d FROM samples) WHERE d > 0 GROUP BY channel"))
def agg_median_rate(spark, sf_dir):
    return S.median_rate(A.samples(spark, sf_dir))


@query("agg_missing_count", _D("SELECT channel, count_if(time_us IS NULL) AS missing_time, count_if(value IS NULL OR isnan(value)) AS missing_value, count_if(time_us IS NULL) + count_if(value IS NULL OR isnan(value)) AS missing FROM samples_dirty GROUP BY channel"))
def agg_missing_count(spark, sf_dir):
    return S.missing_counts(A.samples_dirty(spark, sf_dir))


_GAPS = "gaps AS (SELECT channel, sample_index, time_us, g AS gap_us, CASE WHEN g IS NULL THEN 'first' WHEN g = 0 THEN 'duplicate' WHEN g <> 1000 THEN 'discontinuity' ELSE 'ok' END AS kind FROM (SELECT *, time_us - lag(time_us) OVER (PARTITION BY channel ORDER BY sample_index) AS g FROM samples_dirty WHERE time_us IS NOT NULL))"


@query("agg_anomaly_counts", _D("SELECT channel, count(*) AS n, count_if(kind = 'duplicate') AS duplicates, count_if(kind = 'discontinuity') AS discontinuities FROM gaps GROUP BY channel", _GAPS))
def agg_anomaly_counts(spark, sf_dir):
    return S.anomaly_counts(A.samples_dirty(spark, sf_dir), RATE_HZ)


@query("win_lag_gap", _D("SELECT * FROM gaps", _GAPS))
def win_lag_gap(spark, sf_dir):
    return S.gaps(A.samples_dirty(spark, sf_dir), RATE_HZ).select("channel", "sample_index", "time_us", "gap_us", "kind")


_WIDE = """wide AS (SELECT sample_index AS r, CASE WHEN sample_index % 53 = 7 THEN 1000 * sample_index - 1000 WHEN sample_index % 97 <> 11 THEN 1000 * sample_index END AS t, any_value(CASE WHEN channel = 1 THEN value END) AS c1, any_value(CASE WHEN channel = 2 THEN value END) AS c2, any_value(CASE WHEN channel = 3 THEN value END) AS c3 FROM samples_dirty GROUP BY sample_index),
ms AS (SELECT 'Missing value' AS "Type", 'line ' || r + 5 AS "File", 'time=' || coalesce(t || ' us', 'missing') || ', channel=' || n AS "Value" FROM (SELECT r, t, 'Time[us]' AS n FROM wide WHERE t IS NULL UNION ALL SELECT r, t, '2' FROM wide WHERE c1 IS NULL UNION ALL SELECT r, t, '5' FROM wide WHERE c2 IS NULL UNION ALL SELECT r, t, '260' FROM wide WHERE c3 IS NULL)),
st AS (SELECT r, t, lag(t) OVER (ORDER BY r) AS l FROM wide WHERE t IS NOT NULL),
od AS (SELECT CASE WHEN t = l THEN 'Duplicate timestamp' ELSE 'Time discontinuity' END, 'line ' || r + 5, l || ' -> ' || t || ' us (actual: ' || t - l || ' us, expected: 1000 us)' FROM st WHERE t - l <> 1000),
dt("Type", "File", "Value") AS (SELECT * FROM ms UNION ALL SELECT * FROM od)"""
_REPORT = """SELECT 'Type' AS "Type", 'File' AS "File", 'Value' AS "Value" UNION ALL SELECT 'Summary', 'rec.csv', NULL UNION ALL SELECT 'Rows', NULL, CAST((SELECT count(*) FROM wide) AS VARCHAR) UNION ALL SELECT 'Sample rate', NULL, '1000.0 Hz' UNION ALL SELECT 'Expected interval', NULL, '1000 us'
UNION ALL SELECT 'Missing values', NULL, CAST(count_if("Type" = 'Missing value') AS VARCHAR) FROM dt UNION ALL SELECT 'Duplicate timestamps', NULL, CAST(count_if("Type" = 'Duplicate timestamp') AS VARCHAR) FROM dt UNION ALL SELECT 'Discontinuous timestamps', NULL, CAST(count_if("Type" = 'Time discontinuity') AS VARCHAR) FROM dt UNION ALL SELECT * FROM dt"""


@query("sink_check_report", _D(_REPORT, _WIDE))
def sink_check_report(spark, sf_dir):
    """A recording of three channels with gaps, repeated and missing times is checked; the report is written as one file and read back."""
    rows = A.samples_dirty(spark, sf_dir).groupBy(F.col("sample_index").alias("row")).pivot("channel", [1, 2, 3]).agg(F.first("value"))
    r = F.col("row")
    time = F.when(r % 53 == 7, (r - 1) * 1000.0).when(r % 97 != 11, r * 1000.0)
    wide = rows.select("row", time.alias("time_us"), F.col("1").alias("channel_2"), F.col("2").alias("channel_5"), F.col("3").alias("channel_260"))
    path = fresh_path(spark, "report") + ".csv"
    columns = ["Type", "File", "Value"]
    files.write_csv(S.check_report(wide, RATE_HZ, 3, [2, 5, 260], "rec.csv"), path, columns, ["ord"])
    return spark.read.option("lineSep", "\r\n").schema(", ".join(f"{c} string" for c in columns)).csv(path)


@query("agg_axis_limits", _D(f"SELECT channel, min(time_us) / 1e6 AS x_min, max(time_us) / 1e6 AS x_max, min(v) - (max(v) - min(v)) * 0.05 AS y_min, max(v) + (max(v) - min(v)) * 0.05 AS y_max FROM (SELECT *, CASE WHEN {_OK} THEN value END AS v FROM samples_dirty) GROUP BY channel"))
def agg_axis_limits(spark, sf_dir):
    return S.axis_limits(A.samples_dirty(spark, sf_dir))


@query("agg_color_limits", with_views("vectors", then="SELECT vec_id, CASE WHEN lo = hi THEN lo - greatest(abs(lo) * 0.05, 1) ELSE lo END AS low_db, CASE WHEN lo = hi THEN hi + greatest(abs(hi) * 0.05, 1) ELSE hi END AS high_db FROM (SELECT vec_id, round(min(d), 6) AS lo, round(max(d), 6) AS hi FROM (SELECT vec_id, unnest(list_transform(v[8:24], lambda x: 10 * log10(greatest(x * x, 1.1754943508222875e-38)))) AS d FROM vectors) GROUP BY vec_id)"))
def agg_color_limits(spark, sf_dir):
    band = A.vectors(spark, sf_dir).select("vec_id", F.transform(F.slice("v", 8, 17), lambda x: T.decibels(x * x)).alias("d"))
    r = band.select("vec_id", F.round(F.array_min("d"), 6).alias("lo"), F.round(F.array_max("d"), 6).alias("hi"))
    pad = lambda c: F.greatest(F.abs(F.col(c)) * 0.05, F.lit(1.0))
    same = F.col("lo") == F.col("hi")
    return r.select("vec_id", F.when(same, F.col("lo") - pad("lo")).otherwise(F.col("lo")).alias("low_db"), F.when(same, F.col("hi") + pad("hi")).otherwise(F.col("hi")).alias("high_db"))


_WIN = "w AS (SELECT channel, k * 40 AS window_start, greatest(k * 40, first) AS l, least(k * 40 + 80, last + 1) AS r FROM (SELECT channel, min(sample_index) AS first, max(sample_index) AS last FROM samples GROUP BY channel), LATERAL (SELECT unnest(range(0, last // 40 + 1)) AS k))"


@query("win_regression_windows", _V("SELECT channel, window_start, l AS \"left\", r AS \"right\", r - l AS n FROM w WHERE r - l >= 6", _WIN))
def win_regression_windows(spark, sf_dir):
    return W.regression_windows(A.samples(spark, sf_dir), 80, 40, 6)


@query("st_sliding", _V("SELECT channel, window_start, count(*) AS n, round(sum(value), 6) AS total FROM w JOIN samples USING (channel) WHERE sample_index >= l AND sample_index < r GROUP BY channel, window_start", _WIN))
def st_sliding(spark, sf_dir):
    """Each sample goes to the two windows that hold it by arithmetic on its index; no range join."""
    k = F.floor(F.col("sample_index") / 40)
    rows = A.samples(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.greatest(k - 1, F.lit(0).cast("long")), k)))
    return rows.groupBy("channel", (F.col("k") * 40).alias("window_start")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("agg_overlap_add", _V("SELECT channel, sample_index, round(sum(value * w) / sum(w), 9) AS value FROM (SELECT channel, sample_index, value * (1 + k - sample_index // 40) AS value, 1 + (sample_index - k * 40) % 80 AS w FROM samples, LATERAL (SELECT unnest(range(greatest(sample_index // 40 - 1, 0), sample_index // 40 + 1)) AS k)) GROUP BY channel, sample_index"))
def agg_overlap_add(spark, sf_dir):
    at = F.floor(F.col("sample_index") / 40)
    rows = A.samples(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.greatest(at - 1, F.lit(0).cast("long")), at)))
    parts = rows.select("channel", "sample_index", (F.col("value") * (1 + F.col("k") - at)).alias("part"), (1 + (F.col("sample_index") - F.col("k") * 40) % 80).alias("weight"))
    return W.overlap_add(parts).select("channel", "sample_index", F.round("value", 9).alias("value"))


@query("win_local_max", _D("SELECT channel, sample_index, coalesce(ok AND value >= a AND value >= b AND value >= 30, false) AS is_high, coalesce(ok AND value <= a AND value <= b AND value <= 10, false) AS is_low FROM (SELECT *, a IS NOT NULL AND b IS NOT NULL AND value IS NOT NULL AS ok FROM (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM samples_dirty WINDOW w AS (PARTITION BY channel ORDER BY sample_index)))"))
def win_local_max(spark, sf_dir):
    return W.local_extrema(A.samples_dirty(spark, sf_dir), 30.0, 10.0).select("channel", "sample_index", "is_high", "is_low")


_FLAT = "flat AS (SELECT channel, sample_index, floor(value / 8) AS value FROM samples), s AS (SELECT *, CASE WHEN lag(value) OVER (PARTITION BY channel ORDER BY sample_index) = value THEN 0 ELSE 1 END AS st FROM flat), r AS (SELECT *, sum(st) OVER (PARTITION BY channel ORDER BY sample_index) AS run FROM s), e AS (SELECT channel, run, min(sample_index) AS l, max(sample_index) AS r, any_value(value) AS value FROM r GROUP BY channel, run), o AS (SELECT *, lag(value) OVER (PARTITION BY channel ORDER BY run) AS a, lead(value) OVER (PARTITION BY channel ORDER BY run) AS b FROM e)"


@query("win_plateau", _V("SELECT channel, (l + r) // 2 AS sample_index, l AS \"left\", r AS \"right\", value FROM o WHERE value > a AND value > b", _FLAT))
def win_plateau(spark, sf_dir):
    flat = A.samples(spark, sf_dir).withColumn("value", F.floor(F.col("value") / 8).cast("double"))
    return W.plateaus(flat)


FILL = """g AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN sample_index END IGNORE NULLS) OVER b AS ai, last_value(value IGNORE NULLS) OVER b AS av,
first_value(CASE WHEN value IS NOT NULL THEN sample_index END IGNORE NULLS) OVER f AS bi, first_value(value IGNORE NULLS) OVER f AS bv FROM samples_dirty
WINDOW b AS (PARTITION BY channel ORDER BY sample_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY channel ORDER BY sample_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("win_interp_gaps", _D("SELECT channel, sample_index, round(CASE WHEN ai IS NULL AND bi IS NULL THEN 0 WHEN ai IS NULL THEN bv WHEN bi IS NULL OR ai = bi THEN av ELSE av + (bv - av) * (sample_index - ai) / (bi - ai) END, 9) AS filled FROM g", FILL))
def win_interp_gaps(spark, sf_dir):
    return W.fill_gaps(A.samples_dirty(spark, sf_dir)).select("channel", "sample_index", F.round("filled", 9).alias("filled"))


@query("win_filter_padding", _V("SELECT DISTINCT channel, greatest(27, CAST(ceil(3 * 1000.0 / channel) AS BIGINT)) AS padding FROM samples"))
def win_filter_padding(spark, sf_dir):
    from ..operators.dsp import Settings, padding

    known = [(c, padding(Settings(show_filtered=True, bandpass=True, low_hz=float(c), high_hz=100.0), RATE_HZ)) for c in A.CHANNELS.values()]
    return spark.createDataFrame(known, "channel int, padding long").join(A.samples(spark, sf_dir).select("channel").distinct(), "channel", "left_semi")


_RANGES = "ranges AS (SELECT channel, time_us / 1e6 AS \"left\", time_us / 1e6 + value * 30 AS \"right\" FROM samples)"
_ISLANDS = _RANGES + ", st AS (SELECT *, CASE WHEN \"left\" <= max(\"right\") OVER (PARTITION BY channel ORDER BY \"left\", \"right\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-9 THEN 0 ELSE 1 END AS s FROM ranges), isl AS (SELECT *, sum(s) OVER (PARTITION BY channel ORDER BY \"left\", \"right\") AS k FROM st)"


def _ranges(spark, sf_dir):
    t = F.col("time_us") / 1e6
    return A.samples(spark, sf_dir).select("channel", t.alias("left"), (t + F.col("value") * 30).alias("right"))


@query("win_merge_ranges", _V("SELECT channel, min(\"left\") AS \"left\", max(\"right\") AS \"right\" FROM isl GROUP BY channel, k", _ISLANDS))
def win_merge_ranges(spark, sf_dir):
    return W.merge_ranges(_ranges(spark, sf_dir))


@query("win_display_allocation", with_views("markers", more="iv0 AS (SELECT user_id % 5 AS channel, floor(seq / 100) AS \"left\", count(*) AS m FROM markers GROUP BY 1, 2), iv AS (SELECT channel, \"left\", \"left\" + 1 + m % 13 AS \"right\" FROM iv0), d AS (SELECT *, (\"right\" - \"left\") * (CAST(100 AS DOUBLE) / sum(\"right\" - \"left\") OVER (PARTITION BY channel)) AS share FROM iv), f AS (SELECT *, floor(share) AS base FROM d)", then="SELECT channel, \"left\", \"right\", CAST(base + CASE WHEN row_number() OVER (PARTITION BY channel ORDER BY share - base DESC, \"left\") <= 100 - sum(base) OVER (PARTITION BY channel) THEN 1 ELSE 0 END AS BIGINT) AS points FROM f"))
def win_display_allocation(spark, sf_dir):
    left = F.floor(F.col("seq") / 100)
    iv = A.markers(spark, sf_dir).groupBy((F.col("user_id") % 5).alias("channel"), left.cast("double").alias("left")).agg(F.count("*").alias("m"))
    return W.allocate_points(iv.select("channel", "left", (F.col("left") + 1 + F.col("m") % 13).alias("right")), 100)


@query("win_even_sample", _V("SELECT channel, sample_index, value FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY sample_index) - 1 AS r, count(*) OVER (PARTITION BY channel) AS n FROM samples) WHERE n <= 37 OR r IN (SELECT k * (n - 1) // 36 FROM range(37) AS t(k))"))
def win_even_sample(spark, sf_dir):
    return W.even_sample(A.samples(spark, sf_dir), 37).select("channel", "sample_index", "value")


@query("win_playback_window", _V("SELECT channel, sample_index, CAST(floor(time_us / 3600e6) AS BIGINT) AS bucket FROM samples WHERE floor(time_us / 3600e6) BETWEEN 99 AND 101"))
def win_playback_window(spark, sf_dir):
    return S.playback_windows(A.samples(spark, sf_dir), 361_000.0, 3600.0).select("channel", "sample_index", "bucket")


@query("set_concat_partial", _V("SELECT channel, \"left\", \"right\", false AS is_gap FROM c UNION ALL SELECT channel, e, \"left\", true FROM (SELECT *, lag(\"right\") OVER (PARTITION BY channel ORDER BY \"left\") AS e FROM c) WHERE e < \"left\"", "c AS (SELECT channel, (sample_index // 100) * 100 AS \"left\", (sample_index // 100) * 100 + 100 AS \"right\" FROM samples WHERE sample_index // 100 % 3 <> 1 GROUP BY ALL)"))
def set_concat_partial(spark, sf_dir):
    chunk = F.floor(F.col("sample_index") / 100)
    chunks = A.samples(spark, sf_dir).where(chunk % 3 != 1).select("channel", (chunk * 100).alias("left"), (chunk * 100 + 100).alias("right")).distinct()
    return W.carry_concat(chunks)


@query("join_semi_ready_channels", _V("SELECT channel, count(*) AS n FROM samples WHERE channel IN (SELECT channel FROM samples WHERE value > 440) GROUP BY channel"))
def join_semi_ready_channels(spark, sf_dir):
    s = A.samples(spark, sf_dir)
    return s.join(s.where("value > 440").select("channel").distinct(), "channel", "left_semi").groupBy("channel").agg(F.count("*").alias("n"))


@query("join_anti_pending", _V("SELECT channel, count(*) AS n FROM samples WHERE channel NOT IN (SELECT channel FROM samples WHERE value > 440) GROUP BY channel"))
def join_anti_pending(spark, sf_dir):
    s = A.samples(spark, sf_dir)
    return s.join(s.where("value > 440").select("channel").distinct(), "channel", "left_anti").groupBy("channel").agg(F.count("*").alias("n"))


@query("agg_ready_status", _V("SELECT count_if(r.channel IS NOT NULL) AS ready, count_if(r.channel IS NULL) AS pending FROM (SELECT DISTINCT channel FROM samples) c LEFT JOIN (SELECT DISTINCT channel FROM samples WHERE value > 440) r ON c.channel = r.channel"))
def agg_ready_status(spark, sf_dir):
    s = A.samples(spark, sf_dir)
    done = s.where("value > 440").select("channel").distinct().withColumn("is_ready", F.lit(True))
    return s.select("channel").distinct().join(done, "channel", "left").agg(F.count_if(F.col("is_ready")).alias("ready"), F.count_if(F.col("is_ready").isNull()).alias("pending"))


@query("sp_three_axis", _V("SELECT channel, sample_index, value FROM (SELECT *, (count(*) OVER ()) // 50 AS step FROM samples WHERE channel = 5) WHERE sample_index % greatest(step, 1) = 0 AND sample_index // greatest(step, 1) % 3 = 0"))
def sp_three_axis(spark, sf_dir):
    """The three-axis channel's overview, strided once more."""
    rows = S.overview(S.channel(A.samples(spark, sf_dir), 5), 50)
    return rows.where(F.floor(F.col("sample_index") / F.col("step")) % 3 == 0).select("channel", "sample_index", "value")


_NOTCH = """sp AS (SELECT vec_id AS channel, k - 1 AS bin, (k - 1) * CAST(7.8125 AS DOUBLE) AS freq, v[k] AS db FROM vectors, range(1, 65) AS t(k)),
nr AS (SELECT *, abs(freq - 60) <= greatest(60 / 60.0, 15.625) OR abs(freq - 400) <= greatest(400 / 60.0, 15.625) AS near FROM sp),
bd AS (SELECT *, last_value(CASE WHEN NOT near THEN freq END IGNORE NULLS) OVER p AS fa, last_value(CASE WHEN NOT near THEN db END IGNORE NULLS) OVER p AS da, first_value(CASE WHEN NOT near THEN freq END IGNORE NULLS) OVER q AS fb, first_value(CASE WHEN NOT near THEN db END IGNORE NULLS) OVER q AS db2
FROM nr WINDOW p AS (PARTITION BY channel ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (PARTITION BY channel ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""


@query("win_notch_gap_interp", with_views("vectors", more=_NOTCH, then="SELECT channel, bin, freq, round(CASE WHEN near AND fa IS NOT NULL AND fb IS NOT NULL THEN da + (db2 - da) * (freq - fa) / (fb - fa) ELSE db END, 9) AS db FROM bd"))
def win_notch_gap_interp(spark, sf_dir):
    bins = A.vectors(spark, sf_dir).select(F.col("vec_id").alias("channel"), F.posexplode("v").alias("bin", "db"))
    rows = bins.select("channel", F.col("bin").cast("long").alias("bin"), (F.col("bin") * 7.8125).alias("freq"), "db")
    return W.bridge_notches(rows, [60.0, 400.0], 30.0).select("channel", "bin", "freq", F.round("db", 9).alias("db"))


_SIDES = """tops AS (SELECT *, lag(value) OVER o AS p, lead(value) OVER o AS q, list(value) OVER (PARTITION BY channel ORDER BY sample_index ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS a,
list(value) OVER (PARTITION BY channel ORDER BY sample_index ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS b FROM samples WINDOW o AS (PARTITION BY channel ORDER BY sample_index)),
cut AS (SELECT *, coalesce(nullif(list_position(list_transform(list_reverse(a), lambda v: v > value), true), 0), 99) AS i, coalesce(nullif(list_position(list_transform(b, lambda v: v > value), true), 0), 99) AS j FROM tops WHERE value >= p AND value >= q AND value >= 50)"""


@query("win_prominence", _V("SELECT channel, sample_index, value, value - greatest(least(value, coalesce(list_min((list_reverse(a))[1:i - 1]), value)), least(value, coalesce(list_min(b[1:j - 1]), value))) AS prominence FROM cut", _SIDES))
def win_prominence(spark, sf_dir):
    return B.prominences(W.local_extrema(A.samples(spark, sf_dir), 50.0, -1.0), 12)


PICTURE = (1200, 300)  # pixels
_SPAN = "bd AS (SELECT min(time_us) AS l, max(time_us) AS r FROM samples), px AS (SELECT channel, sample_index, value, CAST(least(floor((time_us - l) / (r - l) * 1200), 1199) AS INTEGER) AS px FROM samples, bd WHERE value IS NOT NULL AND isfinite(value))"


def _columns(spark, sf_dir):
    rows = A.samples(spark, sf_dir)
    left, right = rows.agg(F.min("time_us"), F.max("time_us")).first()
    return I.pixel_columns(rows, left, right, PICTURE[0])


@query("agg_pixel_columns", _V('SELECT channel, px, arg_min(value, sample_index) AS "first", arg_max(value, sample_index) AS "last", min(value) AS low, max(value) AS high FROM px GROUP BY channel, px', _SPAN))
def agg_pixel_columns(spark, sf_dir):
    return _columns(spark, sf_dir)


@query("sink_images", _V("SELECT 'channel' || channel || '_raw.svg' AS file, 'Channel ' || channel AS title, CAST(4 * count(DISTINCT px) AS INTEGER) AS points, CAST(min(px) AS DOUBLE) AS first_x, CAST(max(px) AS DOUBLE) AS last_x, CAST(13.64 AS DOUBLE) AS top, CAST(286.36 AS DOUBLE) AS bottom FROM px GROUP BY channel", _SPAN))
def sink_images(spark, sf_dir):
    """A picture a channel; the files are read back: how many points their line has and how far they reach."""
    path = fresh_path(spark, "images")
    title = F.concat(F.lit("Channel "), F.col("channel").cast("string"))
    I.write_svg(I.as_svg(_columns(spark, sf_dir), *PICTURE, title), path)
    files_ = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("svg"))
    ys = F.transform("points", lambda p: p[1])
    return I.read_svg(files_).select("file", "title", F.size("points").alias("points"), F.array_min("points")[0].alias("first_x"), F.array_max("points")[0].alias("last_x"), F.array_min(ys).alias("top"), F.array_max(ys).alias("bottom"))
