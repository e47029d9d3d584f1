"""Queries of the scalar functions over columns of the event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import settings as S, text as X, time_math as T, video as V
from ..sources import adapters as A
from ..sources.adapters import with_views
from .registry import query

L = lambda v: F.lit(v).cast("long")


def numbered(spark: SparkSession, sf_dir: str, *columns, source=A.events) -> DataFrame:
    return source(spark, sf_dir).select("event_id", *columns)


@query("fn_relative_time", with_views("ev", then="SELECT event_id, time_us / 1e6 - coalesce(CASE WHEN event_id % 3 <> 0 THEN value END, 0) AS relative_sec FROM ev"))
def fn_relative_time(spark, sf_dir):
    return numbered(spark, sf_dir, T.relative_time(F.col("time_us") / 1e6, F.when(F.col("event_id") % 3 != 0, F.col("value"))).alias("relative_sec"))


@query("fn_absolute_time", with_views("ev", then="SELECT event_id, time_us / 1e6 + coalesce(CASE WHEN event_id % 3 <> 0 THEN value END, 0) AS absolute_sec FROM ev"))
def fn_absolute_time(spark, sf_dir):
    return numbered(spark, sf_dir, T.absolute_time(F.col("time_us") / 1e6, F.when(F.col("event_id") % 3 != 0, F.col("value"))).alias("absolute_sec"))


_MOD = lambda x, d: f"((({x}) % {d}) + {d}) % {d}"
_SHIFTED = "CAST(time_us AS BIGINT) - 900000000000"


@query(
    "fn_record_time_parts",
    with_views(
        "ev",
        then=f"SELECT event_id, (us2 - {_MOD('us2', 3600000000)}) // 3600000000 AS hours, ({_MOD('us2', 3600000000)}) // 60000000 AS minutes, (({_MOD('us2', 3600000000)}) % 60000000) // 1000000 AS seconds, {_MOD('us2', 1000000)} AS microseconds FROM (SELECT event_id, {_SHIFTED} AS us2 FROM ev)",
    ),
)
def fn_record_time_parts(spark, sf_dir):
    parts = T.record_time_parts(F.col("time_us").cast("long") - 900_000_000_000)
    return numbered(spark, sf_dir, *(p.alias(n) for p, n in zip(parts, ("hours", "minutes", "seconds", "microseconds"), strict=True)))


@query("fn_frame_to_time", with_views("ev", then="SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 0 ELSE user_id / 29.97 END AS time_sec FROM ev"))
def fn_frame_to_time(spark, sf_dir):
    return numbered(spark, sf_dir, T.frame_to_time(F.col("user_id"), F.when(F.col("event_id") % 11 == 0, 0.0).otherwise(29.97)).alias("time_sec"))


@query("fn_time_to_frame", with_views("ev", then="SELECT event_id, greatest(0, least(CAST(round_even((value - 20) * 30, 0) AS BIGINT), 2999)) AS frame, CAST(round_even((event_id + 0.5) * 1, 0) AS BIGINT) AS half_even FROM ev"))
def fn_time_to_frame(spark, sf_dir):
    return numbered(spark, sf_dir, T.time_to_frame(F.col("value") - 20, F.lit(30.0), L(3000)).alias("frame"), T.time_to_frame(F.col("event_id") + 0.5, F.lit(1.0)).alias("half_even"))


_TEXT_SQL = """CASE event_id % 8 WHEN 0 THEN '' || value WHEN 1 THEN '-' || (event_id % 500) || ':' || (event_id % 70) || '.5'
 WHEN 2 THEN ' ' || (event_id % 30) || ':' || (event_id % 62) || ':' || (event_id % 61) || '.0000005 ' WHEN 3 THEN '+' || event_id || '.1234565' WHEN 4 THEN 'abc'
 WHEN 5 THEN '' WHEN 6 THEN '1:2:3:4' ELSE '.25' END"""


def _time_text():
    i = F.col("event_id")
    s = lambda x: x.cast("string")
    return F.when(i % 8 == 0, s(F.col("value"))).when(i % 8 == 1, F.concat(F.lit("-"), s(i % 500), F.lit(":"), s(i % 70), F.lit(".5"))).when(i % 8 == 2, F.concat(F.lit(" "), s(i % 30), F.lit(":"), s(i % 62), F.lit(":"), s(i % 61), F.lit(".0000005 "))).when(i % 8 == 3, F.concat(F.lit("+"), s(i), F.lit(".1234565"))).when(i % 8 == 4, "abc").when(i % 8 == 5, "").when(i % 8 == 6, "1:2:3:4").otherwise(".25")


_PARSED_SQL = f"""texts AS (SELECT event_id, {_TEXT_SQL} AS t FROM ev),
cut AS (SELECT event_id, trim(t) AS v, string_split(regexp_replace(trim(t), '^[+-]', ''), ':') AS p FROM texts),
num AS (SELECT event_id, v, len(p) AS n, list_transform(p, lambda x: CASE WHEN regexp_full_match(x, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN CAST(x AS DECIMAL(28,9)) END) AS q FROM cut),
parsed AS (SELECT event_id, (CASE WHEN starts_with(v, '-') THEN -1 ELSE 1 END) * CAST(CASE WHEN n = 1 THEN q[1] WHEN n = 2 AND q[1] >= 0 AND q[2] >= 0 AND q[2] < 60 THEN q[1] * 60 + q[2]
 WHEN n = 3 AND q[1] >= 0 AND q[2] >= 0 AND q[2] < 60 AND q[3] >= 0 AND q[3] < 60 THEN q[1] * 3600 + q[2] * 60 + q[3] END AS DECIMAL(28,9)) AS s FROM num)"""


@query("fn_parse_time", with_views("ev", more=_PARSED_SQL, then="SELECT event_id, CAST(s AS DOUBLE) AS seconds FROM parsed"))
def fn_parse_time(spark, sf_dir):
    return numbered(spark, sf_dir, T.parse_time(_time_text()).cast("double").alias("seconds"))


@query("fn_parse_record_us", with_views("ev", more=_PARSED_SQL, then="SELECT event_id, CAST(round(s * 1000000, 0) AS BIGINT) AS us FROM parsed"))
def fn_parse_record_us(spark, sf_dir):
    return numbered(spark, sf_dir, T.parse_record_us(_time_text()).alias("us"))


_FORMAT = "printf('%02d:%02d.%03d', ({0} - " + _MOD("{0}", 60000) + ") // 60000, (" + _MOD("{0}", 60000) + ") // 1000, (" + _MOD("{0}", 60000) + ") % 1000)"


@query("fn_format_time", with_views("ev", then=f"SELECT event_id, {_FORMAT.format('ms')} AS label FROM (SELECT event_id, CAST(round_even(time_us / 1e6 * 1000, 0) AS BIGINT) AS ms FROM ev)"))
def fn_format_time(spark, sf_dir):
    return numbered(spark, sf_dir, T.format_time(F.col("time_us") / 1e6).alias("label"))


@query("fn_format_tick", with_views("ev", then="SELECT event_id, CASE WHEN abs(v) >= 100 THEN printf('%.0f', v) WHEN abs(v) >= 10 THEN printf('%.1f', v) ELSE printf('%.2f', v) END AS label FROM (SELECT event_id, CASE WHEN abs(x) < 0.0005 THEN 0 ELSE x END AS v FROM (SELECT event_id, sqrt(time_us) / 1e3 - coalesce(CASE WHEN event_id % 2 = 0 THEN value END, 0) AS x FROM ev))"))
def fn_format_tick(spark, sf_dir):
    return numbered(spark, sf_dir, T.format_tick(F.sqrt("time_us") / 1e3, F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("label"))


_CLAMP = """CASE WHEN fr - fl <= 0 OR r - l >= fr - fl THEN fl ELSE greatest(CASE WHEN r1 > fr THEN l1 - (r1 - fr) ELSE l1 END, fl) END AS left_sec,
CASE WHEN fr - fl <= 0 OR r - l >= fr - fl THEN fr ELSE least(least(r1, fr), fr) END AS right_sec"""
_CLAMP_FROM = "(SELECT *, CASE WHEN l < fl THEN r + (fl - l) ELSE r END AS r1, greatest(l, fl) AS l1 FROM (SELECT event_id, value - 100 AS l, value - 100 + user_id AS r, CAST(0 AS DOUBLE) AS fl, CAST(100 AS DOUBLE) AS fr FROM ev))"


@query("fn_clamp_range", with_views("ev", then=f"SELECT event_id, {_CLAMP} FROM {_CLAMP_FROM}"))
def fn_clamp_range(spark, sf_dir):
    a, b = T.clamp_range(F.col("value") - 100, F.col("value") - 100 + F.col("user_id"), F.lit(0.0), F.lit(100.0))
    return numbered(spark, sf_dir, a.alias("left_sec"), b.alias("right_sec"))


_FOLLOW = """w0 AS (SELECT event_id, value AS now, CAST(user_id AS DOUBLE) AS l, CAST(user_id + event_id % 130 AS DOUBLE) AS r, CAST(0 AS DOUBLE) AS fl, CAST(120 AS DOUBLE) AS fr FROM ev),
w1 AS (SELECT *, greatest(r - l, 1e-6) AS w FROM w0), w2 AS (SELECT *, CASE WHEN w >= (fr - fl) * 0.98 THEN least(30.0, fr - fl) ELSE least(w, fr - fl) END AS tw, least(greatest(now, fl), fr) AS c FROM w1),
w3 AS (SELECT *, ((w >= (fr - fl) * 0.98 AND tw < w) OR c < l + tw * 0.18 OR c > r - tw * 0.18) AS moved, c - tw * 0.35 AS nl FROM w2), w4 AS (SELECT *, nl + tw AS nr FROM w3),
w5 AS (SELECT *, CASE WHEN nl < fl THEN nr + (fl - nl) ELSE nr END AS r1, greatest(nl, fl) AS l1 FROM w4),
w6 AS (SELECT *, CASE WHEN nr - nl >= fr - fl THEN fl ELSE greatest(CASE WHEN r1 > fr THEN l1 - (r1 - fr) ELSE l1 END, fl) END AS cl, CASE WHEN nr - nl >= fr - fl THEN fr ELSE least(r1, fr) END AS cr FROM w5)"""


@query("fn_follow_window", with_views("ev", more=_FOLLOW, then="SELECT event_id, CASE WHEN tw >= fr - fl THEN fl WHEN moved THEN cl ELSE l END AS left_sec, CASE WHEN tw >= fr - fl THEN fr WHEN moved THEN cr ELSE r END AS right_sec FROM w6"))
def fn_follow_window(spark, sf_dir):
    left = F.col("user_id").cast("double")
    a, b = T.follow_window(F.col("value"), left, (F.col("user_id") + F.col("event_id") % 130).cast("double"), F.lit(0.0), F.lit(120.0))
    return numbered(spark, sf_dir, a.alias("left_sec"), b.alias("right_sec"))


@query("fn_plot_step", with_views("ev", then="SELECT event_id, CASE WHEN event_id % 4 = 0 THEN greatest(user_id - 20, 0) ELSE greatest(event_id * 7 // 5000, 1) END AS step FROM ev"))
def fn_plot_step(spark, sf_dir):
    return numbered(spark, sf_dir, T.plot_step(F.col("event_id") * 7, F.when(F.col("event_id") % 4 == 0, F.col("user_id") - 20)).alias("step"))


@query("fn_visible_step", with_views("ev", then="SELECT event_id, CASE WHEN event_id % 3 = 0 THEN greatest(CAST(ceil(event_id / greatest(CAST(floor((user_id + 0.75) * 2) AS BIGINT), 1)) AS BIGINT), 1) WHEN event_id % 3 = 1 THEN 1 ELSE user_id + 1 END AS step FROM ev"))
def fn_visible_step(spark, sf_dir):
    step = F.when(F.col("event_id") % 3 == 1, L(0)).when(F.col("event_id") % 3 == 2, F.col("user_id") + 1)
    return numbered(spark, sf_dir, T.visible_step(F.col("event_id"), step, F.col("user_id") + 0.75).alias("step"))


@query("fn_coarse_scan_step", with_views("ev", then="SELECT event_id, greatest(CAST(round_even(value * 2 / 3, 0) AS BIGINT), 1) AS step FROM ev"))
def fn_coarse_scan_step(spark, sf_dir):
    return numbered(spark, sf_dir, T.coarse_scan_step(F.col("value")).alias("step"))


@query("fn_rotation", with_views("ev", then=f"SELECT event_id, CASE WHEN {_MOD('d', 360)} IN (0, 90, 180, 270) THEN {_MOD('d', 360)} ELSE 0 END AS degrees FROM (SELECT event_id, (event_id - 500) * 45 AS d FROM ev)"))
def fn_rotation(spark, sf_dir):
    return numbered(spark, sf_dir, T.rotation((F.col("event_id") - 500) * 45).alias("degrees"))


@query("fn_harmonics", with_views("ev", then="SELECT event_id, CASE WHEN CAST(ceil(500.0 / (value + 10)) AS BIGINT) - 1 >= 1 THEN list_transform(range(1, CAST(ceil(500.0 / (value + 10)) AS BIGINT)), lambda k: k * (value + 10)) ELSE [] END AS hz FROM ev"))
def fn_harmonics(spark, sf_dir):
    return numbered(spark, sf_dir, T.harmonics(F.col("value") + 10, F.lit(500.0)).alias("hz"))


@query("fn_db", with_views("ev", then="SELECT event_id, round(10 * log10(greatest(value - 30, 1.1754943508222875e-38)), 6) AS db FROM ev"))
def fn_db(spark, sf_dir):
    return numbered(spark, sf_dir, F.round(T.decibels(F.col("value") - 30), 6).alias("db"))


@query("fn_scan_range", with_views("ev", more=_PARSED_SQL, then="SELECT event_id, greatest(0, least(CAST(round_even(CAST(s AS DOUBLE) * 25, 0) AS BIGINT), 49999)) AS start_frame, s >= 0 AND s < 2000 AS valid FROM parsed WHERE s IS NOT NULL"))
def fn_scan_range(spark, sf_dir):
    seconds = T.parse_time(_time_text())
    return numbered(spark, sf_dir, seconds.alias("s")).where("s is not null").select("event_id", T.time_to_frame(F.col("s").cast("double"), F.lit(25.0), L(50_000)).alias("start_frame"), ((F.col("s") >= 0) & (F.col("s") < 2000)).alias("valid"))


@query("fn_playhead", with_views("ev", then="SELECT event_id, value - o AS record_sec, value + o AS video_sec FROM (SELECT event_id, value, CASE WHEN event_id % 5 <> 0 THEN 12.25 END AS o FROM ev)"))
def fn_playhead(spark, sf_dir):
    offset = F.when(F.col("event_id") % 5 != 0, 12.25)
    return numbered(spark, sf_dir, (F.col("value") - offset).alias("record_sec"), (F.col("value") + offset).alias("video_sec"))


@query("fn_display_time", with_views("ev", then=f"SELECT event_id, CASE WHEN x < 0 THEN '-' ELSE '' END || {_FORMAT.format('ms')} AS label FROM (SELECT event_id, x, CAST(round_even(abs(x) * 1000, 0) AS BIGINT) AS ms FROM (SELECT event_id, value * 3 - 100 AS x FROM ev))"))
def fn_display_time(spark, sf_dir):
    return numbered(spark, sf_dir, T.format_display_time(F.col("value") * 3 - 100).alias("label"))


@query("fn_edit_position", with_views("ev", then="SELECT event_id, f AS frame, CASE WHEN t >= 0 THEN f / 29.97 ELSE t END AS time_sec FROM (SELECT event_id, t, greatest(0, least(CAST(round_even(t * 29.97, 0) AS BIGINT), 8999)) AS f FROM (SELECT event_id, value * 2 - 20 AS t FROM ev))"))
def fn_edit_position(spark, sf_dir):
    frame, t = T.snap_position(F.col("value") * 2 - 20, F.lit(29.97), L(9000))
    return numbered(spark, sf_dir, frame.alias("frame"), t.alias("time_sec"))


@query("fn_export_range", with_views("ev", then="SELECT event_id, least(value + 5, user_id + 5) AS start_sec, greatest(value + 5, user_id + 5) AS end_sec FROM ev"))
def fn_export_range(spark, sf_dir):
    a, b = T.ordered_range(F.col("value"), F.col("user_id").cast("double"), F.lit(5.0))
    return numbered(spark, sf_dir, a.alias("start_sec"), b.alias("end_sec"))


_SLIDER = f"""c1 AS (SELECT event_id, {_CLAMP} FROM {_CLAMP_FROM.replace('user_id', 'user_id / 20')}),
c2 AS (SELECT event_id, left_sec AS l, right_sec AS r0, left_sec + 4.0 AS r, CAST(0 AS DOUBLE) AS fl, CAST(100 AS DOUBLE) AS fr FROM c1),
c3 AS (SELECT *, CASE WHEN l < fl THEN r + (fl - l) ELSE r END AS r1, greatest(l, fl) AS l1 FROM c2), c4 AS (SELECT event_id, l, r0, {_CLAMP} FROM c3)"""


@query("fn_slider_range", with_views("ev", more=_SLIDER, then="SELECT event_id, CASE WHEN r0 - l < 4.0 THEN left_sec ELSE l END AS left_sec, CASE WHEN r0 - l < 4.0 THEN right_sec ELSE r0 END AS right_sec FROM c4"))
def fn_slider_range(spark, sf_dir):
    a, b = T.slider_range(F.col("value") - 100, F.col("value") - 100 + F.col("user_id") / 20, F.lit(0.0), F.lit(100.0), F.lit(4.0))
    return numbered(spark, sf_dir, a.alias("left_sec"), b.alias("right_sec"))


_UNIT_SQL = "CASE event_id % 6 WHEN 0 THEN 'uv' WHEN 1 THEN 'µV' WHEN 2 THEN ' μ v ' WHEN 3 THEN '  m   V ' WHEN 4 THEN '' ELSE 'Deg C' END"


def _unit_text():
    k = F.col("event_id") % 6
    return F.when(k == 0, "uv").when(k == 1, "µV").when(k == 2, " μ v ").when(k == 3, "  m   V ").when(k == 4, "").otherwise("Deg C")


@query("fn_normalize_unit", with_views("ev", then=f"SELECT event_id, CASE WHEN replace(lower(u), ' ', '') IN ('uv', 'µv', 'μv') THEN 'uV' ELSE trim(regexp_replace(u, '\\s+', ' ', 'g')) END AS unit FROM (SELECT event_id, {_UNIT_SQL} AS u FROM ev)"))
def fn_normalize_unit(spark, sf_dir):
    return numbered(spark, sf_dir, X.normalize_unit(_unit_text()).alias("unit"))


_FREQ_SQL = "CASE event_id % 4 WHEN 0 THEN '50, 60;  50' WHEN 1 THEN (user_id + 1) || ' 120 ' || (user_id + 1) || '.0' WHEN 2 THEN '  ' ELSE '60,,180.5' END"


def _freq_text():
    k, u = F.col("event_id") % 4, (F.col("user_id") + 1).cast("string")
    return F.when(k == 0, "50, 60;  50").when(k == 1, F.concat(u, F.lit(" 120 "), u, F.lit(".0"))).when(k == 2, "  ").otherwise("60,,180.5")


_FREQ = f"SELECT event_id, list_filter(list_transform(f, lambda x, i: CASE WHEN list_position(f, x) = i THEN x END), lambda x: x IS NOT NULL) AS hz FROM (SELECT event_id, list_transform(list_filter(regexp_split_to_array({_FREQ_SQL}, '[,;\\s]+'), lambda x: x <> ''), lambda x: CAST(x AS DOUBLE)) AS f FROM ev)"


@query("fn_parse_freqs", with_views("ev", then=_FREQ))
def fn_parse_freqs(spark, sf_dir):
    return numbered(spark, sf_dir, X.parse_frequencies(_freq_text()).alias("hz"))


@query("set_distinct_freqs", with_views("ev", then=f"SELECT event_id, CAST(len(hz) AS BIGINT) AS n, hz FROM ({_FREQ})"))
def set_distinct_freqs(spark, sf_dir):
    hz = X.parse_frequencies(_freq_text())
    return numbered(spark, sf_dir, F.size(hz).cast("long").alias("n"), hz.alias("hz"))


@query("fn_signal_label", with_views("ev", then=f"SELECT event_id, CASE WHEN u = '' THEN 'Signal' ELSE 'Signal (' || u || ')' END AS label FROM (SELECT event_id, {_UNIT_SQL} AS u FROM ev)"))
def fn_signal_label(spark, sf_dir):
    return numbered(spark, sf_dir, X.signal_label(_unit_text()).alias("label"))


@query("fn_channel_label", with_views("ev", then="SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'Time[us]' WHEN event_id % 5 <= 3 THEN CAST(([2, 5, 260])[event_id % 5] AS VARCHAR) ELSE event_type END AS label FROM ev"))
def fn_channel_label(spark, sf_dir):
    return numbered(spark, sf_dir, X.channel_label(F.col("event_id") % 5, F.array(L(2), L(5), L(260)), F.col("event_type")).alias("label"))


@query("fn_fourcc", with_views("ev", then="SELECT event_id, chr(97 + (event_id % 26)::INT) || chr(65 + (user_id % 26)::INT) || chr(48 + (event_id % 10)::INT) || 'v' AS code FROM ev"))
def fn_fourcc(spark, sf_dir):
    value = 97 + F.col("event_id") % 26 + (65 + F.col("user_id") % 26) * 256 + (48 + F.col("event_id") % 10) * 65536 + L(118) * 16777216
    return numbered(spark, sf_dir, X.fourcc(value).alias("code"))


@query(
    "fn_marker_to_json",
    with_views("markers", then="""SELECT seq, '{"marker_id":"' || marker_id || '","kind":"' || kind || '","source":"' || source || '","position":{"domain":"' || domain || '","time_us":' || CAST(round_even(time_sec * 1e6, 0) AS BIGINT) || CASE WHEN frame_index IS NOT NULL THEN ',"frame_index":' || frame_index ELSE '' END || '},"note":"' || note || '"}' AS json FROM markers"""),
)
def fn_marker_to_json(spark, sf_dir):
    return A.markers(spark, sf_dir).select("seq", X.marker_to_json().alias("json"))


@query("fn_marker_from_json", with_views("markers", then="SELECT seq, marker_id, kind, CASE WHEN seq % 6 = 0 THEN 'video' ELSE domain END AS domain, CAST(round_even(time_sec * 1e6, 0) AS BIGINT) AS time_us, frame_index, note FROM markers"))
def fn_marker_from_json(spark, sf_dir):
    rows = A.markers(spark, sf_dir).withColumn("domain", F.when(F.col("seq") % 6 == 0, "unknown").otherwise(F.col("domain")))
    return rows.select("seq", X.marker_from_json(X.marker_to_json()).alias("m")).select("seq", "m.*")


@query("fn_settings_to_json", with_views("ev", then="""SELECT event_id, '{"bandpass_enabled":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ',"low_hz":' || user_id || ',"frequencies_hz":[' || (user_id + 50) || ',' || (user_id + 100) || ']}' AS json FROM ev"""))
def fn_settings_to_json(spark, sf_dir):
    return numbered(spark, sf_dir, F.to_json(F.struct((F.col("event_id") % 2 == 0).alias("bandpass_enabled"), F.col("user_id").alias("low_hz"), F.array(F.col("user_id") + 50, F.col("user_id") + 100).alias("frequencies_hz"))).alias("json"))


@query("fn_output_names", with_views("ev", then="SELECT event_id, 'output_data/rec.' || user_id || '_check_report.csv' AS report, 'rec.' || user_id || '_channel_' || event_id % 300 || CASE WHEN event_id % 2 = 0 THEN '_filtered' ELSE '_raw' END || CASE WHEN event_id % 3 = 0 THEN '' ELSE '_' || event_type END || '.png' AS image FROM ev"))
def fn_output_names(spark, sf_dir):
    path = F.concat(F.lit("/data/rec."), F.col("user_id").cast("string"), F.lit(".csv"))
    suffix = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type"))
    return numbered(spark, sf_dir, X.report_name(path).alias("report"), X.image_name(path, F.col("event_id") % 300, F.col("event_id") % 2 == 0, suffix).alias("image"))


@query("sp_roi_map", with_views("ev", then="""SELECT event_id, CAST(trunc((x - 8) * (1920 / 640.0)) AS INTEGER) AS x, CAST(trunc((y - 4) * (1080 / 361.0)) AS INTEGER) AS y, CAST(trunc(w * (1920 / 640.0)) AS INTEGER) AS width, CAST(trunc(h * (1080 / 361.0)) AS INTEGER) AS height FROM (
SELECT event_id, greatest(xa, 8) AS x, least(xb, 647) - greatest(xa, 8) + 1 AS w, greatest(ya, 4) AS y, least(yb, 364) - greatest(ya, 4) + 1 AS h FROM (
SELECT event_id, CASE WHEN x2 < x1 - 1 THEN x2 + 1 ELSE x1 END AS xa, CASE WHEN x2 < x1 - 1 THEN x1 - 1 ELSE x2 END AS xb, CASE WHEN y2 < y1 - 1 THEN y2 + 1 ELSE y1 END AS ya, CASE WHEN y2 < y1 - 1 THEN y1 - 1 ELSE y2 END AS yb FROM (
SELECT event_id, event_id * 7 % 700 AS x1, event_id * 11 % 400 AS y1, event_id * 13 % 700 AS x2, event_id * 17 % 400 AS y2 FROM ev))) WHERE w >= 3 AND h >= 3"""))
def sp_roi_map(spark, sf_dir):
    i = F.col("event_id")
    roi = V.dragged_roi((i * 7 % 700, i * 11 % 400), (i * 13 % 700, i * 17 % 400), (L(8), L(4), L(640), L(361)), (L(1920), L(1080)))
    return numbered(spark, sf_dir, roi.alias("roi")).where("roi is not null").select("event_id", "roi.*")


_STATUS = """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'LED detection completed: no events found' ELSE 'LED detection' END || ': Frame delta | ' || user_id % 5 || ' intervals | scan frames=0-' || event_id || ' | coarse step=20 frames | refine window=1.0s | points=' || user_id
|| ' | TTL-guided event limit | requested=' || CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id % 5 END || ' | threshold=' || printf('%.6f', value / 7) || ' | duration=0.6-1.5s target=1.0s | ' || CASE WHEN user_id % 5 = 0 THEN 'no LED event selected' ELSE 'event pairs=' || user_id % 5 END
|| ' | scan=' || printf('%.1f', event_id * 0.25) || 's detect=0.0s' || CASE event_id % 3 WHEN 0 THEN ' | brightness=CPU' WHEN 1 THEN ' | brightness=OpenCL | selected=auto | batch=fixed | capacity=0 | batches=' || event_id || ' | max_batch=0' ELSE '' END AS status FROM ev"""
_SHORT = "array_to_string(list_filter(string_split(status, ' | '), lambda p, k: k = 1 OR contains(p, 'interval') OR contains(p, 'scan frames=') OR contains(p, 'points=') OR contains(p, 'requested=') OR contains(p, 'threshold=') OR contains(p, 'duration=') OR contains(p, 'scan=') OR contains(p, 'brightness='))[1:8], ' | ')"


@query("fn_led_status", with_views("ev", then=f"SELECT event_id, status, {_SHORT} AS short FROM ({_STATUS})"))
def fn_led_status(spark, sf_dir):
    i = F.col("event_id")
    stats = {
        "event_count": F.col("user_id") % 5, "scan_outcome": F.when(i % 4 == 0, "no_events"), "scan_end_frame": i, "points_count": F.col("user_id"), "requested_event_count": F.when(i % 3 == 0, 7),
        "threshold": F.col("value") / 7, "scan_elapsed_sec": i * 0.25, "brightness_backend": F.when(i % 3 == 0, "cpu").when(i % 3 == 1, "opencl"), "opencl_batches": i,
    }
    return numbered(spark, sf_dir, X.led_status(stats).alias("status")).select("event_id", "status", F.array_join(X.short_status(F.col("status")), " | ").alias("short"))


_HZ = "(user_id + 40)"


def _settings_text() -> Column:
    """Settings as JSON texts of eight kinds: none, old scalar, list, old harmonics, broken ones, other methods."""
    u = F.col("user_id").cast("string")
    hz = (F.col("user_id") + 40).cast("string")
    kinds = (
        F.lit("{}"), F.concat(F.lit('{"line_noise_hz": '), hz, F.lit(', "show_filtered": true}')), F.concat(F.lit('{"line_noise_frequencies_hz": ['), hz, F.lit(", 120.5], \"show_filtered\": true, \"notch_quality\": 12.5}")),
        F.concat(F.lit('{"regression_harmonics": 3, "line_noise_method": "regression", "line_noise_hz": '), hz, F.lit(', "show_filtered": true}')), F.lit('{"notch_quality": -1.0, "line_noise_hz": null, "show_filtered": true}'),
        F.concat(F.lit('{"line_noise_method": "none", "bandpass_enabled": true, "show_filtered": true, "bandpass_low_hz": 0.'), u, F.lit("}")), F.lit('{"notch_quality": "much", "regression_overlap": 1.5, "line_noise_method": "other"}'), F.lit(None).cast("string"),
    )
    return F.get(F.array(*kinds), (F.col("event_id") % 8).cast("int"))


def _settings() -> Column:
    return S.migrate(_settings_text(), F.when(F.col("event_id") % 16 == 8, 50.0))


_KIND = "event_id % 8"
_OLD = "event_id % 16 = 8"
_METHOD = f"CASE {_KIND} WHEN 0 THEN CASE WHEN {_OLD} THEN 'notch' ELSE 'none' END WHEN 1 THEN 'notch' WHEN 2 THEN 'notch' WHEN 3 THEN 'regression' WHEN 4 THEN 'none' WHEN 5 THEN 'none' WHEN 6 THEN 'other' ELSE 'none' END"
_LIST = f"CASE {_KIND} WHEN 0 THEN CASE WHEN {_OLD} THEN [50.0]::DOUBLE[] ELSE []::DOUBLE[] END WHEN 1 THEN [{_HZ}]::DOUBLE[] WHEN 2 THEN [{_HZ}, 120.5]::DOUBLE[] WHEN 3 THEN [{_HZ}]::DOUBLE[] ELSE []::DOUBLE[] END"


@query("fn_migrate_settings", with_views("ev", then=f"SELECT event_id, {_METHOD} AS method, {_LIST} AS hz, CASE {_KIND} WHEN 0 THEN CASE WHEN {_OLD} THEN CAST(50 AS DOUBLE) END WHEN 1 THEN {_HZ} WHEN 2 THEN {_HZ} WHEN 3 THEN {_HZ} END AS first_hz, {_KIND} = 3 AS all_harmonics, CASE {_KIND} WHEN 2 THEN CAST(12.5 AS DOUBLE) WHEN 4 THEN -1 WHEN 6 THEN NULL ELSE 30 END AS quality, {_KIND} BETWEEN 1 AND 5 AS show_filtered FROM ev"))
def fn_migrate_settings(spark, sf_dir):
    s = F.col("s")
    rows = numbered(spark, sf_dir, _settings().alias("s"))
    return rows.select("event_id", s["line_noise_method"].alias("method"), s["line_noise_frequencies_hz"].alias("hz"), s["line_noise_hz"].alias("first_hz"), s["regression_all_harmonics"].alias("all_harmonics"), s["notch_quality"].alias("quality"), s["show_filtered"].alias("show_filtered"))


@query("filter_settings_valid", with_views("ev", then=f"SELECT event_id, CASE {_KIND} WHEN 4 THEN 'quality' WHEN 6 THEN 'method,quality,overlap' ELSE '' END AS broken FROM ev"))
def filter_settings_valid(spark, sf_dir):
    return numbered(spark, sf_dir, _settings().alias("s")).select("event_id", F.array_join(S.problems(F.col("s")), ",").alias("broken"))


_TEXTS = f"CASE {_KIND} WHEN 1 THEN 'Filtered: bandpass off (low 1 Hz, high 100 Hz), notch ' || {_HZ} || ' Hz (Q=30)' WHEN 2 THEN 'Filtered: bandpass off (low 1 Hz, high 100 Hz), notch ' || {_HZ} || ', 120.5 Hz (Q=12.5)' WHEN 3 THEN 'Filtered: bandpass off (low 1 Hz, high 100 Hz), sinusoidal regression ' || {_HZ} || ' Hz, 4 s, 50% overlap, all harmonics below Nyquist' WHEN 4 THEN 'Filtered: bandpass off (low 1 Hz, high 100 Hz), line-noise removal off' WHEN 5 THEN 'Filtered: bandpass ' || printf('%g', CAST('0.' || user_id AS DOUBLE)) || '-100 Hz, line-noise removal off' ELSE 'Raw' END"


@query("fn_filter_description", with_views("ev", then=f"SELECT event_id, {_TEXTS} AS description FROM ev"))
def fn_filter_description(spark, sf_dir):
    return numbered(spark, sf_dir, _settings().alias("s")).select("event_id", S.describe(F.col("s")).alias("description"))


@query("fn_settings_for_view", with_views("ev", then="SELECT event_id, user_id % 2 = 0 AS show_filtered, CASE WHEN event_id % 8 = 6 THEN CAST(1.5 AS DOUBLE) ELSE 0.5 END AS overlap FROM ev"))
def fn_settings_for_view(spark, sf_dir):
    seen = S.for_view(F.when(F.col("event_id") % 5 != 0, _settings()).otherwise(F.when(F.col("event_id") % 8 == 6, _settings())), F.col("user_id") % 2 == 0)
    return numbered(spark, sf_dir, seen.alias("s")).select("event_id", "s.show_filtered", F.col("s.regression_overlap").alias("overlap"))


@query("fn_notch_options", with_views("ev", then=f"SELECT event_id, {_LIST} AS frequencies_hz, CASE {_KIND} WHEN 2 THEN CAST(12.5 AS DOUBLE) ELSE 30 END AS quality_factor FROM ev WHERE {_KIND} IN (1, 2)"))
def fn_notch_options(spark, sf_dir):
    return numbered(spark, sf_dir, _settings().alias("s")).select("event_id", S.notch_options(F.col("s")).alias("o")).where("o is not null").select("event_id", "o.*")


@query("fn_settings_from_text", with_views("ev", then=f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'notch' ELSE 'regression' END AS method, CASE WHEN event_id % 3 = 0 THEN []::DOUBLE[] ELSE [{_HZ}, 1000]::DOUBLE[] END AS hz, CASE WHEN event_id % 3 <> 0 THEN CAST({_HZ} AS DOUBLE) END AS first_hz, (user_id % 100) / 100 AS overlap FROM ev"))
def fn_settings_from_text(spark, sf_dir):
    hz = (F.col("user_id") + 40).cast("string")
    method = F.get(F.array(*map(F.lit, S.METHODS)), (F.col("event_id") % 3).cast("int"))
    made = S.from_controls(filtered=F.lit(True), bandpass=F.lit(False), low_hz=F.lit(1.0), high_hz=F.lit(90.0), method=method, frequency_text=F.concat(hz, F.lit(", 1000; "), hz), quality=F.lit(30.0), window_sec=F.lit(4.0), overlap_percent=F.col("user_id") % 100, all_harmonics=F.lit(False))
    s = F.col("s")
    return numbered(spark, sf_dir, made.alias("s")).select("event_id", s["line_noise_method"].alias("method"), s["line_noise_frequencies_hz"].alias("hz"), s["line_noise_hz"].alias("first_hz"), s["regression_overlap"].alias("overlap"))


@query("scan_video_meta", with_views("ev", then="""SELECT event_id, 'cam' || user_id || CASE WHEN event_id % 3 = 0 THEN '.MP4' WHEN event_id % 3 = 1 THEN '.avi' ELSE '' END AS filename, CASE event_id % 3 WHEN 0 THEN 'mp4' WHEN 1 THEN 'avi' ELSE '' END AS file_format, CASE WHEN event_id % 7 = 0 THEN 'unknown' WHEN event_id % 7 = 1 THEN 'XV' ELSE 'avc1' END AS codec,
CAST(event_id % 3 * 640 AS INTEGER) AS width, CAST(event_id % 5 * 240 AS INTEGER) AS height, CAST(event_id % 4 * 15 AS DOUBLE) AS detected_fps, CAST(CASE WHEN event_id % 4 = 0 THEN 30 ELSE event_id % 4 * 15 END AS DOUBLE) AS using_fps, CAST(user_id AS BIGINT) AS total_frames, CASE WHEN event_id % 4 = 0 THEN CAST(0 AS DOUBLE) ELSE user_id / (event_id % 4 * 15) END AS detected_duration_sec, CASE WHEN event_id % 4 = 0 THEN CAST(0 AS DOUBLE) ELSE user_id / (event_id % 4 * 15) END AS duration_sec FROM ev"""))
def scan_video_meta(spark, sf_dir):
    """A decoder's facts, a row a video, as the library shows them."""
    i = F.col("event_id")
    path = F.concat(F.lit("/videos/cam"), F.col("user_id").cast("string"), F.when(i % 3 == 0, ".MP4").when(i % 3 == 1, ".avi").otherwise(""))
    avc1, xv = (sum(ord(c) << 8 * k for k, c in enumerate(code)) for code in ("avc1", "XV  "))
    codec = F.when(i % 7 == 0, L(0)).when(i % 7 == 1, L(xv)).otherwise(L(avc1))
    facts = V.metadata(path, F.when(i % 3 != 0, i % 3 * 640), i % 5 * 240, i % 4 * 15, F.col("user_id"), codec)
    return numbered(spark, sf_dir, *(c.alias(n) for n, c in facts.items()))
