"""Queries over marker tables, peaks and brightness curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import time_math as T
from ..operators import caches as K, led as D, markers as M
from ..sources import adapters as A, containers, files, ttl as TTL
from ..sources.adapters import FPS, with_views
from ..sources.shared import fresh_path
from .registry import query

_M = lambda then, more="": with_views("markers", then=then, more=more)
_P = lambda then, more="": with_views("peaks", then=then, more=more)
_SYNC = """tt AS (SELECT min(time_sec) AS t, arg_min(marker_id, (time_sec, seq)) AS id FROM markers WHERE kind = 'ttl'),
vv AS (SELECT min(time_sec) AS t, arg_min(marker_id, (time_sec, seq)) AS id FROM markers WHERE kind = 'led_on'), sy AS (SELECT tt.id AS ttl_id, vv.id AS video_id, vv.t - tt.t AS o, vv.t AS origin FROM tt, vv)"""
_VIDEO, _RECORD = "CASE WHEN domain = 'video' THEN time_sec ELSE time_sec + o END", "CASE WHEN domain = 'record' THEN time_sec ELSE time_sec - o END"


def _synced(spark, sf_dir):
    m = A.markers(spark, sf_dir)
    return m, M.sync(m)


@query("proj_marker_video_time", _M(f"SELECT seq, {_VIDEO} AS video_sec FROM markers, sy", _SYNC))
def proj_marker_video_time(spark, sf_dir):
    m, one = _synced(spark, sf_dir)
    return M.with_offset(m, one).select("seq", M.video_time(F.col("offset_sec")).alias("video_sec"))


@query("proj_marker_record_time", _M(f"SELECT seq, {_RECORD} AS record_sec FROM markers, sy", _SYNC))
def proj_marker_record_time(spark, sf_dir):
    m, one = _synced(spark, sf_dir)
    return M.with_offset(m, one).select("seq", M.record_time(F.col("offset_sec")).alias("record_sec"))


@query("join_offset", _M(f"SELECT seq, o AS offset_sec, {_VIDEO} AS video_sec, {_RECORD} AS record_sec FROM markers, sy", _SYNC))
def join_offset(spark, sf_dir):
    m, one = _synced(spark, sf_dir)
    return M.with_offset(m, one).select("seq", "offset_sec", M.video_time(F.col("offset_sec")).alias("video_sec"), M.record_time(F.col("offset_sec")).alias("record_sec"))


@query("sp_sync", _M("SELECT ttl_id, video_id, o AS offset_sec, origin AS video_origin_sec FROM sy", _SYNC))
def sp_sync(spark, sf_dir):
    return M.sync(A.markers(spark, sf_dir))


@query("agg_earliest", _M("SELECT kind, arg_min(marker_id, (time_sec, seq)) AS marker_id, min(time_sec) AS time_sec FROM markers WHERE kind IN ('ttl', 'led_on') GROUP BY kind"))
def agg_earliest(spark, sf_dir):
    return M.earliest(A.markers(spark, sf_dir))


@query("join_marker_id", _M("SELECT marker_id, kind, time_sec FROM markers WHERE marker_id IN ('m7', 'm11', 'm12', 'nope')"))
def join_marker_id(spark, sf_dir):
    wanted = spark.createDataFrame([("m7",), ("m11",), ("m12",), ("nope",)], "marker_id string")
    return A.markers(spark, sf_dir).join(F.broadcast(wanted), "marker_id").select("marker_id", "kind", "time_sec")


_PAIRS = """ps AS (SELECT *, sum(CASE WHEN kind IN ('led_on', 'action_start') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, substr(kind, 1, 3) ORDER BY seq) AS isl FROM markers WHERE kind <> 'ttl'),
st AS (SELECT user_id, substr(kind, 1, 3) AS k, isl, time_sec AS s, marker_id AS sid FROM ps WHERE kind IN ('led_on', 'action_start')),
en AS (SELECT ps.user_id, st.k, st.isl, s, sid, arg_min(marker_id, seq) AS eid, arg_min(time_sec, seq) AS e FROM ps JOIN st ON ps.user_id = st.user_id AND substr(kind, 1, 3) = st.k AND ps.isl = st.isl WHERE kind IN ('led_off', 'action_end') AND time_sec > s GROUP BY ALL)"""


@query("win_pair_intervals", _M("SELECT user_id, sid AS start_marker_id, eid AS end_marker_id, s AS start_sec, e AS end_sec FROM en WHERE k = 'act'", _PAIRS))
def win_pair_intervals(spark, sf_dir):
    return M.pair_intervals(A.markers(spark, sf_dir), "action_start", "action_end")


@query("sp_event_intervals", _M("SELECT 'ttl' AS event_type, time_sec AS start_sec, NULL::DOUBLE AS end_sec, marker_id AS start_marker_id, NULL::VARCHAR AS end_marker_id FROM markers WHERE kind = 'ttl' UNION ALL SELECT CASE k WHEN 'act' THEN 'action' ELSE 'led' END, s - o, e - o, sid, eid FROM en, sy", _SYNC + ", " + _PAIRS))
def sp_event_intervals(spark, sf_dir):
    return M.event_intervals(*_synced(spark, sf_dir))


_WARN = """nv AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS number FROM markers WHERE domain = 'video'),
lg AS (SELECT *, lag(kind) OVER p AS k, lag(time_sec) OVER p AS t, lag(number) OVER p AS n FROM nv WHERE kind IN ('led_on', 'led_off', 'action_start', 'action_end') WINDOW p AS (PARTITION BY user_id, substr(kind, 1, 3) ORDER BY seq)),
bd AS (SELECT user_id, number, CASE WHEN k IS NULL OR k IN ('led_off', 'action_end') THEN kind || ' has no start' WHEN time_sec <= t THEN kind || ' isn''t after #' || n END AS problem FROM lg WHERE kind IN ('led_off', 'action_end'))"""


@query("win_interval_warning", _M("SELECT user_id, min(number) AS number, arg_min(problem, number) AS problem FROM bd WHERE problem IS NOT NULL GROUP BY user_id", _WARN))
def win_interval_warning(spark, sf_dir):
    return M.interval_warning(A.markers(spark, sf_dir))


@query("sink_exportable_rows", _M(f"SELECT seq, kind AS marker_type, {_VIDEO} AS video_time_sec, coalesce(frame_index, CAST(round_even(({_VIDEO}) * 30, 0) AS BIGINT)) AS frame_index, note FROM markers, sy", _SYNC))
def sink_exportable_rows(spark, sf_dir):
    return M.exportable(*_synced(spark, sf_dir), FPS)


_NOTE = "CASE WHEN seq % 5 = 0 THEN note || ', \"seen\"' ELSE note END"
_EXPORT = f"ex AS (SELECT seq, kind AS marker_type, {_VIDEO} AS t, coalesce(frame_index, CAST(round_even(({_VIDEO}) * 30, 0) AS BIGINT)) AS frame_index, {_NOTE} AS note FROM markers, sy)"


def _exported(spark, sf_dir):
    """The exportable rows; every fifth note has a comma and quotes."""
    rows = M.exportable(*_synced(spark, sf_dir), FPS)
    return rows.withColumn("note", F.when(F.col("seq") % 5 == 0, F.concat("note", F.lit(', "seen"'))).otherwise(F.col("note")))


EXPORTED = ["marker_type", "video_time_sec", "frame_index", "note"]


@query("sink_markers_csv", _M("SELECT 'marker_type,video_time_sec,frame_index,note' AS line UNION ALL SELECT marker_type || ',' || printf('%.6f', t) || ',' || frame_index || ',' || CASE WHEN contains(note, '\"') THEN '\"' || replace(note, '\"', '\"\"') || '\"' ELSE note END FROM ex", _SYNC + ", " + _EXPORT))
def sink_markers_csv(spark, sf_dir):
    """One CSV file; its lines are read back."""
    path = fresh_path(spark, "markers") + ".csv"
    rows = _exported(spark, sf_dir).withColumn("video_time_sec", T.fixed(F.col("video_time_sec"), 6))
    files.write_csv(rows, path, EXPORTED, ["seq"])
    return spark.read.option("lineSep", "\r\n").text(path).select(F.col("value").alias("line"))


@query("sink_markers_xlsx", _M("SELECT 0 AS \"row\", 'marker_type' AS marker_type, 'video_time_sec' AS video_time_sec, 'frame_index' AS frame_index, 'note' AS note UNION ALL SELECT row_number() OVER (ORDER BY seq), marker_type, CAST(round(t, 3) AS VARCHAR), CAST(frame_index AS VARCHAR), nullif(note, '') FROM ex", _SYNC + ", " + _EXPORT))
def sink_markers_xlsx(spark, sf_dir):
    """One workbook; its cells are read back."""
    path = fresh_path(spark, "markers") + ".xlsx"
    rows = _exported(spark, sf_dir).withColumn("video_time_sec", T.rounded(F.col("video_time_sec"), 3))
    files.write_xlsx(rows, path, EXPORTED, ["seq"], "Markers")
    return files.read_xlsx(spark, path).select("row", *(F.get("cells", k).alias(c) for k, c in enumerate(EXPORTED)))


@query("proj_row_number", _M("SELECT seq, kind, number FROM (SELECT *, row_number() OVER (ORDER BY seq) AS number FROM markers WHERE domain = 'video') WHERE kind IN ('led_on', 'action_start')"))
def proj_row_number(spark, sf_dir):
    video = A.markers(spark, sf_dir).where("domain = 'video'")
    return M.number_rows(video, F.floor(F.col("seq") / 100_000), ["seq"]).where(F.col("kind").isin("led_on", "action_start")).select("seq", "kind", "number")


_HMS = "printf('%02d:%02d:%02d.%06d', us // 3600000000, us // 60000000 % 60, us // 1000000 % 60, us % 1000000)"


def _hms(us):
    h, m, s, f = T.record_time_parts(us)
    return F.format_string("%02d:%02d:%02d.%06d", h, m, s, f)


@query("proj_ttl_table", _M(f"SELECT marker_id, row_number() OVER (ORDER BY time_sec, seq) AS number, {_HMS} AS record_text FROM (SELECT *, CAST(round_even(time_sec * 1000000, 0) AS BIGINT) AS us FROM markers WHERE kind = 'ttl')"))
def proj_ttl_table(spark, sf_dir):
    ttl = A.markers(spark, sf_dir).where("kind = 'ttl'")
    rows = M.number_rows(ttl, F.floor(F.col("time_sec") / 86_400), ["time_sec", "seq"])
    return rows.select("marker_id", "number", _hms(F.rint(F.col("time_sec") * 1_000_000).cast("long")).alias("record_text"))


@query("sink_ttl_rows", _M(f"SELECT row_number() OVER (ORDER BY seq) AS marker_index, strftime(make_timestamp(1722384000000000 + us) + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S.%f') AS local_time, us AS record_time_us, {_HMS} AS record_time FROM (SELECT *, CAST(round_even(time_sec * 1000000, 0) AS BIGINT) AS us FROM markers WHERE kind = 'ttl')"))
def sink_ttl_rows(spark, sf_dir):
    ttl = A.markers(spark, sf_dir).where("kind = 'ttl'").withColumn("us", F.rint(F.col("time_sec") * 1_000_000).cast("long"))
    rows = M.number_rows(ttl, F.floor(F.col("seq") / 100_000), ["seq"], "marker_index")
    return rows.select("marker_index", TTL.local_text(F.lit(1_722_384_000_000_000) + F.col("us")).alias("local_time"), F.col("us").alias("record_time_us"), _hms(F.col("us")).alias("record_time"))


_TTL_TEXT = "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'x' ELSE (1722384000000000 + event_id * 1000) || '.7' END AS l, CASE WHEN event_id % 13 = 0 THEN '' ELSE CAST(CAST(time_us AS BIGINT) AS VARCHAR) || '.999' END AS r FROM ev"


def _ttl_text(spark, sf_dir):
    i = F.col("event_id")
    local = F.when(i % 9 == 0, "x").otherwise(F.concat((F.lit(1_722_384_000_000_000) + i * 1000).cast("string"), F.lit(".7")))
    record = F.when(i % 13 == 0, "").otherwise(F.concat(F.col("time_us").cast("long").cast("string"), F.lit(".999")))
    return A.events(spark, sf_dir).select("event_id", local.alias("local_time(us)"), record.alias("record_time(us)"))


@query("scan_ttl_csv", with_views("ev", more=f"tx AS ({_TTL_TEXT})", then="SELECT event_id, CAST(trunc(CAST(l AS DECIMAL(28,9))) AS BIGINT) AS local_time_us, us AS record_time, us // 3600000000 AS record_hours, us // 60000000 % 60 AS record_minutes, us // 1000000 % 60 AS record_seconds, us % 1000000 AS record_microseconds FROM (SELECT *, CAST(trunc(CAST(r AS DECIMAL(28,9))) AS BIGINT) AS us FROM tx WHERE l <> 'x' AND r <> '')"))
def scan_ttl_csv(spark, sf_dir):
    return TTL.parse_rows(_ttl_text(spark, sf_dir)).select("event_id", "local_time_us", "record_time", "record_hours", "record_minutes", "record_seconds", "record_microseconds")


@query("scan_ttl_markers", with_views("ev", "markers", more=f"tx AS ({_TTL_TEXT})", then="SELECT seq, kind, time_sec FROM markers WHERE kind <> 'ttl' UNION ALL SELECT (SELECT max(seq) FROM markers) + 1 + event_id, 'ttl', CAST(trunc(CAST(r AS DECIMAL(28,9))) AS BIGINT) / 1e6 FROM tx WHERE l <> 'x' AND r <> ''"))
def scan_ttl_markers(spark, sf_dir):
    m = A.markers(spark, sf_dir).select("seq", "kind", "time_sec")
    new = TTL.parse_rows(_ttl_text(spark, sf_dir)).select(F.col("event_id").alias("seq"), F.lit("ttl").alias("kind"), (F.col("record_time") / 1e6).alias("time_sec"))
    return M.replace_where(m, F.col("kind") == "ttl", new)


_STATUS = """nm AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY seq) AS vno, row_number() OVER (PARTITION BY kind ORDER BY time_sec, seq) AS tno FROM markers)"""


@query("proj_sync_status", _M("SELECT false AS is_manual, 'Sync: Automatic (TTL #1 <-> Video #' || vno || ' LED On)' AS label, false AS is_warning FROM nm, sy WHERE marker_id = video_id UNION ALL SELECT true, 'Sync: Manual (TTL #' || a.tno || ' <-> Video #' || b.vno || ' ' || CASE b.kind WHEN 'led_on' THEN 'LED On' ELSE 'Action Start' END || ')', false FROM (SELECT * FROM nm WHERE kind = 'ttl' ORDER BY seq DESC LIMIT 1) a, (SELECT * FROM nm WHERE kind = 'action_start' ORDER BY seq DESC LIMIT 1) b UNION ALL SELECT true, 'Manual sync selection is no longer available. Select sync events again.', true", _SYNC + ", " + _STATUS))
def proj_sync_status(spark, sf_dir):
    """The automatic pair, the pair of the last TTL and the last action start, and a pair whose TTL is gone."""
    m = A.markers(spark, sf_dir)
    last = m.agg(*(F.max_by("marker_id", F.when(F.col("kind") == k, F.col("seq"))).alias(k) for k in ("ttl", "action_start"))).first()
    return M.sync_status(m).unionByName(M.sync_status(m, last.ttl, last.action_start)).unionByName(M.sync_status(m, "gone", last.action_start))


@query("proj_led_marker", _M("SELECT 'l' || seq AS marker_id, kind, time_sec, frame_index, value / 500 AS brightness FROM markers WHERE kind IN ('led_on', 'led_off')"))
def proj_led_marker(spark, sf_dir):
    return A.markers(spark, sf_dir).where(F.col("kind").isin("led_on", "led_off")).select(F.concat(F.lit("l"), F.col("seq").cast("string")).alias("marker_id"), "kind", "time_sec", "frame_index", (F.col("value") / 500).alias("brightness"))


@query("proj_peak_marker", _P("SELECT seq, 'channel=' || channel || ', value=' || printf('%.6g', value) || CASE WHEN value < 0 THEN ', negative peak' ELSE ', positive peak' END AS note FROM peaks WHERE channel IS NOT NULL"))
def proj_peak_marker(spark, sf_dir):
    return A.peaks(spark, sf_dir).where("channel is not null").select("seq", M.peak_note(F.col("channel"), F.col("value"), F.col("value") < 0).alias("note"))


_NEG = "coalesce(negative, value < 0, false)"


@query("proj_peak_table", _P(f"SELECT seq, CASE WHEN {_NEG} THEN 'Negative' ELSE 'Positive' END AS polarity, CASE WHEN seq % 10 = 0 THEN '--' ELSE printf('%.3f', time_sec) END AS time_text, printf('%.6g', value) AS value_text FROM peaks"))
def proj_peak_table(spark, sf_dir):
    t = F.when(F.col("seq") % 10 != 0, T.fixed(F.col("time_sec"), 3))
    return A.peaks(spark, sf_dir).select("seq", F.when(M.is_negative(F.col("negative"), F.col("value")), "Negative").otherwise("Positive").alias("polarity"), F.coalesce(t, F.lit("--")).alias("time_text"), F.coalesce(M.format_g6(F.col("value")), F.lit("--")).alias("value_text"))


@query("filter_by_kind", _M("SELECT seq, kind, time_sec FROM markers WHERE kind = 'led_on'"))
def filter_by_kind(spark, sf_dir):
    return A.markers(spark, sf_dir).where("kind = 'led_on'").select("seq", "kind", "time_sec")


@query("filter_by_source", _M("SELECT seq, source, time_sec FROM markers WHERE source = 'manual'"))
def filter_by_source(spark, sf_dir):
    return A.markers(spark, sf_dir).where("source = 'manual'").select("seq", "source", "time_sec")


@query("filter_panel_predicate", _M("SELECT seq, kind FROM markers WHERE kind <> 'ttl' AND note <> ''"))
def filter_panel_predicate(spark, sf_dir):
    return A.markers(spark, sf_dir).where((F.col("kind") != "ttl") & (F.col("note") != "")).select("seq", "kind")


@query("filter_peak_polarity", _P(f"SELECT seq, {_NEG} AS is_negative FROM peaks WHERE {_NEG}"))
def filter_peak_polarity(spark, sf_dir):
    negative = M.is_negative(F.col("negative"), F.col("value"))
    return A.peaks(spark, sf_dir).where(negative).select("seq", negative.alias("is_negative"))


@query("filter_exclude_ranges", _M("SELECT seq, frame_index FROM markers WHERE frame_index IS NOT NULL AND NOT (frame_index <= 20000000 AND frame_index + 15 >= 10000000) AND NOT (frame_index <= 50000000 AND frame_index + 15 >= 40000000)"))
def filter_exclude_ranges(spark, sf_dir):
    m = A.markers(spark, sf_dir).where("frame_index is not null")
    return D.outside_ranges(m, [(10_000_000, 20_000_000), (40_000_000, 50_000_000)], F.col("frame_index"), F.col("frame_index") + 15).select("seq", "frame_index")


@query("filter_exclude_marker_ranges", _M("SELECT seq, frame_index FROM markers a WHERE kind LIKE 'led%' AND NOT EXISTS (SELECT 1 FROM markers b WHERE b.kind LIKE 'action%' AND a.frame_index <= b.frame_index + 3000 AND a.frame_index + 15 >= b.frame_index - 3000)"))
def filter_exclude_marker_ranges(spark, sf_dir):
    """Brightness markers that lie away from every action: as many ranges to leave out as there are action markers."""
    m = A.markers(spark, sf_dir).where("frame_index is not null")
    frame = F.col("frame_index")
    actions = m.where(F.col("kind").startswith("action")).select((frame - 3000).alias("left"), (frame + 3000).alias("right"))
    return D.outside_ranges(m.where(F.col("kind").startswith("led")), actions, frame, frame + 15).select("seq", "frame_index")


@query("filter_stale_result", _M("SELECT seq, user_id FROM (SELECT *, max(seq) OVER (PARTITION BY user_id) AS newest, arg_max(kind, seq) OVER (PARTITION BY user_id) AS k FROM markers) WHERE seq = newest AND kind = k"))
def filter_stale_result(spark, sf_dir):
    """A result counts if its request is the session's latest and its source is the current one."""
    m = A.markers(spark, sf_dir)
    now = m.groupBy("user_id").agg(F.max("seq").alias("newest"), F.max_by("kind", "seq").alias("current"))
    return m.join(now, "user_id").where("seq = newest and kind = current").select("seq", "user_id")


@query("sort_peaks", _P(f"SELECT seq, channel, value FROM peaks WHERE channel = 2 AND {_NEG} ORDER BY value DESC, seq"))
def sort_peaks(spark, sf_dir):
    return M.sort_peaks(A.peaks(spark, sf_dir), channel=2, polarity="negative", by="value", descending=True).select("seq", "channel", "value")


@query("sort_ttl", _M("SELECT seq, time_sec FROM markers WHERE kind = 'ttl' ORDER BY time_sec, seq"))
def sort_ttl(spark, sf_dir):
    return A.markers(spark, sf_dir).where("kind = 'ttl'").orderBy("time_sec", "seq").select("seq", "time_sec")


@query("agg_peaks_per_minute", _P("SELECT channel, CAST(floor(time_sec / 60) AS BIGINT) AS minute, count(*) AS n FROM peaks GROUP BY ALL"))
def agg_peaks_per_minute(spark, sf_dir):
    return M.peaks_per_minute(A.peaks(spark, sf_dir))


_FOLD = """pt AS (SELECT channel, list(DISTINCT time_sec ORDER BY time_sec) AS ts FROM (SELECT coalesce(channel, 0) AS channel, floor(time_sec / 400) * 400 AS time_sec FROM peaks) GROUP BY channel),
fo AS (SELECT channel, list_reduce(ts[2:], lambda a, t: CASE WHEN t - 300 <= a[len(a)] AND greatest(a[len(a)], t + 300) - a[len(a) - 1] <= 2000 THEN list_concat(a[:len(a) - 1], [greatest(a[len(a)], t + 300)]) ELSE list_concat(a, [t - 300, t + 300]) END, [ts[1] - 300, ts[1] + 300]) AS a FROM pt)"""


@query("win_merge_peak_intervals", _P("SELECT channel, a[2 * k - 1] AS \"left\", a[2 * k] AS \"right\" FROM fo, LATERAL (SELECT unnest(range(1, len(a) // 2 + 1)) AS k)", _FOLD))
def win_merge_peak_intervals(spark, sf_dir):
    from ..operators.intervals import peak_intervals

    t = A.peaks(spark, sf_dir).select(F.coalesce("channel", F.lit(0)).alias("channel"), (F.floor(F.col("time_sec") / 400) * 400).cast("double").alias("time_sec"))
    return peak_intervals(t, 300.0, 2000.0)


@query("join_peak_overlay", with_views("samples", then="SELECT channel, time_us, value, is_exact FROM (SELECT *, row_number() OVER (PARTITION BY channel, time_us ORDER BY is_exact DESC, value) AS k FROM (SELECT channel, time_us, value, false AS is_exact FROM samples WHERE sample_index % 10 = 0 UNION ALL SELECT channel, time_us, value + 1, true FROM samples WHERE value > 40)) WHERE k = 1"))
def join_peak_overlay(spark, sf_dir):
    s = A.samples(spark, sf_dir).select("channel", "time_us", "value", "sample_index")
    return M.overlay(s.where("sample_index % 10 = 0").drop("sample_index"), s.where("value > 40").select("channel", "time_us", (F.col("value") + 1).alias("value")))


@query("join_interval_samples", with_views("samples", then="SELECT k, count(*) AS n, round(sum(value), 6) AS total FROM samples JOIN (SELECT k, k * 86400e6 + 3600e6 AS a, k * 86400e6 + 7200e6 AS b FROM range(0, 30) AS t(k)) ON time_us BETWEEN a AND b GROUP BY k"))
def join_interval_samples(spark, sf_dir):
    """Samples in display intervals: both sides meet by day, the intervals' number being bounded by the point budget."""
    k = F.col("k")
    intervals = spark.range(30).withColumnRenamed("id", "k").select("k", (k * 86_400e6 + 3600e6).alias("a"), (k * 86_400e6 + 7200e6).alias("b"))
    rows = A.samples(spark, sf_dir).withColumn("k", F.floor(F.col("time_us") / 86_400e6))
    inside = rows.join(F.broadcast(intervals), "k").where(F.col("time_us").between(F.col("a"), F.col("b")))
    return inside.groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def _editable(spark, sf_dir):
    return A.markers(spark, sf_dir).select("marker_id", "seq", "kind", "source", "time_sec", "note")


_EDIT = "SELECT marker_id, seq, kind, source, time_sec, note FROM markers"


@query("set_update", _M("SELECT marker_id, seq, kind, source, CASE WHEN seq % 10 = 0 THEN time_sec + 1 ELSE time_sec END AS time_sec, CASE WHEN seq % 10 = 0 THEN 'edited' ELSE note END AS note FROM markers"))
def set_update(spark, sf_dir):
    return M.update_where(_editable(spark, sf_dir), F.col("seq") % 10 == 0, time_sec=F.col("time_sec") + 1, note=F.lit("edited"))


@query("set_delete", _M(_EDIT + " WHERE marker_id NOT IN ('m5', 'm6')"))
def set_delete(spark, sf_dir):
    return _editable(spark, sf_dir).where(~F.col("marker_id").isin("m5", "m6"))


@query("set_clear", _M(_EDIT + " WHERE false"))
def set_clear(spark, sf_dir):
    return _editable(spark, sf_dir).limit(0)


@query("set_add", _M(_EDIT + " UNION ALL SELECT 'added', (SELECT max(seq) FROM markers) + 1, 'led_on', 'manual', 1.0, ''"))
def set_add(spark, sf_dir):
    """A row with a new id is appended; an id that is there already is an error."""
    m = _editable(spark, sf_dir)
    new = spark.createDataFrame([("added", 0, "led_on", "manual", 1.0, "")], m.schema)
    clash = m.join(F.broadcast(new.select("marker_id")), "marker_id", "left_semi").agg(F.count("*").alias("clashes"))
    checked = new.crossJoin(F.broadcast(clash)).withColumn("note", F.when(F.col("clashes") > 0, F.raise_error(F.lit("the id is taken")).cast("string")).otherwise(F.col("note"))).drop("clashes")
    return M.replace_where(m, F.lit(False), checked)


@query("set_replace_all", _M(_EDIT + " WHERE kind = 'ttl'"))
def set_replace_all(spark, sf_dir):
    return _editable(spark, sf_dir).where("kind = 'ttl'")


_AFTER = "(SELECT max(seq) FROM markers) + 1 + seq"
_NEW = "SELECT 'n' || seq, {after}, kind, source, time_sec, 'new' FROM markers WHERE seq % 50 = 0 AND {what}"


def _new(m, what):
    return m.where(F.col("seq") % 50 == 0).where(what).withColumn("marker_id", F.concat(F.lit("n"), F.col("seq").cast("string"))).withColumn("note", F.lit("new"))


@query("set_replace_by_source", _M(_EDIT + " WHERE source <> 'led_detection' UNION ALL " + _NEW.format(after=_AFTER, what="source = 'led_detection'")))
def set_replace_by_source(spark, sf_dir):
    m = _editable(spark, sf_dir)
    return M.replace_where(m, F.col("source") == "led_detection", _new(m, F.col("source") == "led_detection"))


@query("set_replace_by_kind", _M(_EDIT + " WHERE kind <> 'ttl' UNION ALL " + _NEW.format(after=_AFTER, what="kind = 'ttl'")))
def set_replace_by_kind(spark, sf_dir):
    m = _editable(spark, sf_dir)
    return M.replace_where(m, F.col("kind") == "ttl", _new(m, F.col("kind") == "ttl"))


@query("set_replace_channel_peaks", _P("SELECT seq, channel, source, value FROM peaks WHERE NOT coalesce(source = 'auto' AND channel = 2, false) UNION ALL SELECT (SELECT max(seq) FROM peaks) + 1 + seq, channel, source, value * 2 FROM peaks WHERE source = 'auto' AND channel = 2 AND seq % 3 = 0"))
def set_replace_channel_peaks(spark, sf_dir):
    p = A.peaks(spark, sf_dir).select("seq", "channel", "source", "value")
    old = (F.col("source") == "auto") & (F.col("channel") == 2)
    return M.replace_where(p, old, p.where(old & (F.col("seq") % 3 == 0)).withColumn("value", F.col("value") * 2))


@query("set_add_manual_ttl", _M(_EDIT + " UNION ALL SELECT 'manual_ttl', (SELECT max(seq) FROM markers) + 1, 'ttl', 'manual', 3723.5, ''"))
def set_add_manual_ttl(spark, sf_dir):
    m = _editable(spark, sf_dir)
    new = spark.range(1).select(F.lit("manual_ttl").alias("marker_id"), F.lit(0).cast("long").alias("seq"), F.lit("ttl").alias("kind"), F.lit("manual").alias("source"), (T.parse_record_us(F.lit("01:02:03.5")) / 1e6).alias("time_sec"), F.lit("").alias("note"))
    return M.replace_where(m, F.lit(False), new)


@query("set_add_manual_marker", _M(_EDIT + " UNION ALL SELECT 'manual_marker', (SELECT max(seq) FROM markers) + 1, 'action_start', 'manual', 12.5, ''"))
def set_add_manual_marker(spark, sf_dir):
    m = _editable(spark, sf_dir)
    return M.replace_where(m, F.lit(False), spark.createDataFrame([("manual_marker", 0, "action_start", "manual", 12.5, "")], m.schema))


_ORDER = """vd AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM markers WHERE domain = 'video'),
mv AS (SELECT *, max(CASE WHEN marker_id = 'm50' THEN n END) OVER (PARTITION BY user_id) AS a, least(3, c) AS b FROM vd),
pl AS (SELECT *, CASE WHEN a IS NULL THEN n WHEN n = a THEN b WHEN a < b AND n > a AND n <= b THEN n - 1 WHEN a > b AND n >= b AND n < a THEN n + 1 ELSE n END AS place FROM mv)"""


@query("sort_reorder", _M("SELECT pl.marker_id, vd.seq, pl.kind, pl.user_id FROM pl JOIN vd ON pl.user_id = vd.user_id AND pl.place = vd.n UNION ALL SELECT marker_id, seq, kind, user_id FROM markers WHERE domain <> 'video'", _ORDER))
def sort_reorder(spark, sf_dir):
    return M.reorder(A.markers(spark, sf_dir), "m50", 3, "user_id").select("marker_id", "seq", "kind", "user_id")


_L = lambda then, more="": with_views("led_curve", then=then, more=more)
_DELTA = "dl AS (SELECT * FROM (SELECT frame_index, video_time_sec, brightness, brightness - lag(brightness) OVER (ORDER BY frame_index) AS delta FROM led_curve) WHERE delta IS NOT NULL)"


@query("win_frame_delta", _L("SELECT frame_index, delta FROM dl", _DELTA))
def win_frame_delta(spark, sf_dir):
    return D.deltas(A.led_curve(spark, sf_dir)).select("frame_index", "delta")


@query("agg_led_threshold", _L("SELECT round(greatest(3 * avg(abs(delta)), 1e-6), 9) AS threshold FROM dl", _DELTA))
def agg_led_threshold(spark, sf_dir):
    return D.threshold(D.deltas(A.led_curve(spark, sf_dir))).select(F.round("threshold", 9).alias("threshold"))


@query("agg_mean_threshold", _L("SELECT round(coalesce(avg(t), 0), 8) AS threshold FROM (SELECT frame_index // 25 AS w, greatest(3 * avg(abs(delta)), 1e-6) AS t FROM dl GROUP BY w)", _DELTA))
def agg_mean_threshold(spark, sf_dir):
    per = D.deltas(A.led_curve(spark, sf_dir)).groupBy(F.floor(F.col("frame_index") / 25).alias("w")).agg(F.greatest(3 * F.avg(F.abs("delta")), F.lit(1e-6)).alias("t"))
    return per.agg(F.round(F.coalesce(F.avg("t"), F.lit(0.0)), 8).alias("threshold"))


@query("proj_led_series", _L("SELECT video_time_sec, delta, CAST(0.05 AS DOUBLE) AS upper, CAST(-0.05 AS DOUBLE) AS lower FROM dl", _DELTA))
def proj_led_series(spark, sf_dir):
    return D.deltas(A.led_curve(spark, sf_dir)).select("video_time_sec", "delta", F.lit(0.05).alias("upper"), F.lit(-0.05).alias("lower"))


_THETA = "SELECT a.frame_index AS on_frame, b.frame_index AS off_frame, round(b.video_time_sec - a.video_time_sec, 9) AS duration_sec, round(abs(a.delta) + abs(b.delta) - 0.1 * abs(b.video_time_sec - a.video_time_sec - 1), 9) AS score FROM dl a JOIN dl b ON b.frame_index > a.frame_index AND b.video_time_sec - a.video_time_sec BETWEEN 0.6 AND 1.5 WHERE a.delta > 0.02 AND b.delta < -0.02"


@query("join_on_off_theta", _L(_THETA, _DELTA))
def join_on_off_theta(spark, sf_dir):
    pairs = D.on_off_pairs(D.deltas(A.led_curve(spark, sf_dir)), 0.02)
    return pairs.select("on_frame", "off_frame", F.round("duration_sec", 9).alias("duration_sec"), F.round("score", 9).alias("score"))


@query("join_nearest_point", _L("SELECT query_id, f AS query_frame, arg_min(frame_index, (abs(frame_index - f), frame_index)) AS frame_index, arg_min(brightness, (abs(frame_index - f), frame_index)) AS brightness FROM (SELECT event_id AS query_id, event_id AS f FROM ev), (SELECT * FROM led_curve WHERE frame_index % 4 = 1) GROUP BY ALL"))
def join_nearest_point(spark, sf_dir):
    """Every event asks for the point nearest to the frame of its id, among a curve of every fourth frame."""
    q = A.events(spark, sf_dir).select(F.col("event_id").alias("query_id"), F.col("event_id").alias("frame_index"))
    return D.nearest_points(q, A.led_curve(spark, sf_dir).where("frame_index % 4 = 1"))


@query("scan_led_brightness_gpu", with_views("ev", then="SELECT event_id // 50 AS frame_index, round(avg(0.114 * (event_id % 256) + 0.587 * (user_id % 256) + 0.299 * (CAST(floor(value) AS BIGINT) % 256)) / 255, 9) AS brightness FROM ev GROUP BY ALL"))
def scan_led_brightness_gpu(spark, sf_dir):
    pixels = A.events(spark, sf_dir).select(F.floor(F.col("event_id") / 50).alias("frame_index"), (F.col("event_id") % 256).alias("b"), (F.col("user_id") % 256).alias("g"), (F.floor("value") % 256).alias("r"))
    return D.frame_brightness(pixels).select("frame_index", F.round("brightness", 9).alias("brightness"))


_FRAMES = """px AS (SELECT event_id // 48 AS frame_index, 7 - (event_id % 48) % 8 AS x, 5 - (event_id % 48) // 8 AS y, event_id % 256 AS b, user_id % 256 AS g, CAST(floor(value) AS BIGINT) % 256 AS r, count(*) OVER (PARTITION BY event_id // 48) AS n FROM ev),
half AS (SELECT frame_index, x, y, (sum(b) + 2) // 4 AS b, (sum(g) + 2) // 4 AS g, (sum(r) + 2) // 4 AS r FROM (SELECT frame_index, (x - 1) // 2 AS x, (y - 1) // 2 AS y, b, g, r FROM px WHERE n = 48 AND x BETWEEN 1 AND 4 AND y BETWEEN 1 AND 4) GROUP BY ALL)"""


@query("scan_led_brightness_cpu", with_views("ev", more=_FRAMES, then="SELECT frame_index, frame_index / 30.0 AS video_time_sec, round(avg((b * 1868 + g * 9617 + r * 4899 + 8192) // 16384) / 255, 9) AS brightness FROM half WHERE frame_index >= 2 AND frame_index % 2 = 0 GROUP BY frame_index"))
def scan_led_brightness_cpu(spark, sf_dir):
    """48 events in turn are a frame of 8 by 6 pixels: upside down, a region of 4 by 4, every second frame from the third."""
    i = F.col("event_id")
    value = F.col("value").cast("long") % 256
    pixel = F.struct(i.alias("i"), F.concat(*(F.unhex(F.lpad(F.hex(c.cast("long")), 2, "0")) for c in (i % 256, F.col("user_id") % 256, value))).alias("p"))
    rows = A.events(spark, sf_dir).groupBy(F.floor(i / 48).alias("frame_index")).agg(F.array_sort(F.collect_list(pixel)).alias("pixels"))
    whole = F.unhex(F.array_join(F.transform("pixels", lambda x: F.hex(x["p"])), ""))
    frames = rows.select("frame_index", F.lit(8).alias("width"), F.lit(6).alias("height"), whole.alias("pixels"))
    return D.brightness_curve(frames, roi=(1, 1, 4, 4), rotation=180, step=2, start=2).withColumn("brightness", F.round("brightness", 9))


_SCORED = "SELECT a.frame_index AS x, b.frame_index AS y, abs(a.delta) + abs(b.delta) - 0.1 * abs(b.video_time_sec - a.video_time_sec - 1.0) AS s FROM dl a JOIN dl b ON b.frame_index > a.frame_index AND b.video_time_sec - a.video_time_sec BETWEEN 0.6 AND 1.5 WHERE a.delta > {least} AND b.delta < -{least}"
_TOP = "SELECT * FROM {src} ORDER BY s DESC, x, y LIMIT 1"


def _greedy(least: str) -> str:
    """The three best pairs in turn, each at least 15 frames from those before."""
    free = lambda k: f"SELECT {k}.* FROM {k}, t{k} WHERE NOT ({k}.x <= t{k}.y + 15 AND {k}.y >= greatest(t{k}.x - 15, 0))"
    return f"{_DELTA}, p1 AS ({_SCORED.format(least=least)}), tp1 AS ({_TOP.format(src='p1')}), p2 AS ({free('p1')}), tp2 AS ({_TOP.format(src='p2')}), p3 AS ({free('p2')}), tp3 AS ({_TOP.format(src='p3')}), best AS (SELECT * FROM tp1 UNION ALL SELECT * FROM tp2 UNION ALL SELECT * FROM tp3)"


@query("topk_led_pairs", _L("SELECT x AS on_frame, y AS off_frame FROM best", _greedy("0.02")))
def topk_led_pairs(spark, sf_dir):
    changes = D.deltas(A.led_curve(spark, sf_dir))
    pairs = D.choose_pairs(D.on_off_pairs(changes, 0.02), 3, 15)
    return spark.createDataFrame(pairs, "on_frame long, off_frame long")


@query("sp_led_detect", _L("SELECT 'led_on' AS event_type, frame_index, video_time_sec, brightness FROM led_curve JOIN best ON frame_index = x UNION ALL SELECT 'led_off', frame_index, video_time_sec, brightness FROM led_curve JOIN best ON frame_index = y", _greedy("(SELECT greatest(3 * avg(abs(delta)), 1e-6) FROM dl)")))
def sp_led_detect(spark, sf_dir):
    return D.detect(A.led_curve(spark, sf_dir), most=3)


@query("sp_led_refine")
def sp_led_refine(spark, sf_dir):
    points = A.led_curve(spark, sf_dir)
    coarse = D.choose_pairs(D.on_off_pairs(D.deltas(points.where("frame_index % 5 = 0")), 0.01), 3, 15)
    pairs = spark.createDataFrame([(k, a / FPS, b / FPS) for k, (a, b) in enumerate(coarse)], "pair_id int, on_sec double, off_sec double")
    return D.refine(points, pairs)


_ENTRIES = """en AS (SELECT 'root' || user_id % 20 AS root, 'c' || event_id % 997 AS path, 'rec' || user_id % 7 AS source, event_id % 10 = 0 AS protected, CAST(floor(value * 100) AS BIGINT) AS size, time_us / 1e6 AS used, event_id FROM ev)"""


def _entries(spark, sf_dir):
    """Events as entries of caches: whose they are, their source, size and time of last use."""
    i, u = F.col("event_id"), F.col("user_id")
    name = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    return A.events(spark, sf_dir).select(name("root", u % 20).alias("root"), name("c", i % 997).alias("path"), name("rec", u % 7).alias("source"), (i % 10 == 0).alias("protected"), F.floor(F.col("value") * 100).alias("size"), (F.col("time_us") / 1e6).alias("used"), "event_id")


@query("agg_cache_size", with_views("ev", more=_ENTRIES + """, lv AS (SELECT *, sum(size) OVER (PARTITION BY root) - coalesce(sum(CASE WHEN NOT protected THEN size ELSE 0 END) OVER (PARTITION BY root ORDER BY used, size, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM en WHERE protected OR used > 86400)""", then="SELECT root, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM lv WHERE l <= 60000 OR protected GROUP BY root"))
def agg_cache_size(spark, sf_dir):
    """What is left of each cache when what wasn't used since the first day and the oldest beyond a budget is gone."""
    return K.sizes(K.within_budget(_entries(spark, sf_dir), ["root"], 60_000, 86_400.0), ["root"])


@query("topk_brightness_lru", with_views("ev", more=_ENTRIES, then="SELECT root, path, used FROM (SELECT root, path, max(used) AS used, row_number() OVER (PARTITION BY root ORDER BY max(used) DESC, path) AS k FROM en GROUP BY root, path) WHERE k <= 5"))
def topk_brightness_lru(spark, sf_dir):
    return K.latest(_entries(spark, sf_dir), ["root"], 5)


@query("scan_signal_source_registry", with_views("ev", more=_ENTRIES, then="SELECT path, arg_max(used, event_id) AS used, arg_max(size, event_id) AS size FROM en GROUP BY path"))
def scan_signal_source_registry(spark, sf_dir):
    return K.registered(_entries(spark, sf_dir), ["used", "size"], "event_id")


@query("set_clear_cache", with_views("ev", more=_ENTRIES, then="SELECT event_id, source FROM en WHERE source <> 'rec3'"))
def set_clear_cache(spark, sf_dir):
    return K.without_source(_entries(spark, sf_dir), "rec3").select("event_id", "source")


@query("set_reset_sync", _M("SELECT CAST(0 AS BIGINT) AS markers, NULL::VARCHAR AS ttl_id, NULL::VARCHAR AS video_id, NULL::DOUBLE AS offset_sec, 'Sync: Automatic selection needs a TTL and an LED On.' AS label"))
def set_reset_sync(spark, sf_dir):
    """A new video empties the markers; pair, offset and label follow from the empty table."""
    none = A.markers(spark, sf_dir).where(F.lit(False))
    return none.agg(F.count("*").alias("markers")).crossJoin(M.sync(none).drop("video_origin_sec")).crossJoin(M.sync_status(none).select("label"))


def _number(x, little: bool):
    """Four bytes of a whole number in hex."""
    h = F.lpad(F.hex(x.cast("long")), 8, "0")
    return F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1))) if little else h


def _container(width, height, fps, frames, little: bool):
    """The head of a video file in hex: AVI (little-endian) or MP4, of fixed length."""
    text = lambda s: F.lit(s.encode().hex())
    n = lambda x: _number(x if not isinstance(x, int) else F.lit(x), little)
    none = lambda k: F.lit("00" * k)
    if little:
        main = [text("avih"), n(56), none(16), n(frames), none(12), n(width), n(height), none(16)]
        stream = [text("LIST"), n(68), text("strlstrh"), n(56), text("vidsH264"), none(12), n(1), n(fps), n(0), n(frames), none(20)]
        return F.concat(text("RIFF"), n(156), text("AVI LIST"), n(144), text("hdrl"), *main, *stream)
    box = lambda size, name: [n(size), text(name)]
    track = [*box(92, "tkhd"), none(76), n(width * 65536), n(height * 65536)]
    media = [*box(32, "mdhd"), none(12), n(fps * 100), n(frames * 100), none(4), *box(32, "hdlr"), none(8), text("vide"), none(12)]
    table = [*box(32, "stsd"), none(4), n(1), n(16), text("avc1"), none(8), *box(24, "stts"), none(4), n(1), n(frames), n(100)]
    return F.concat(*box(16, "ftyp"), text("isom"), none(4), *box(252, "moov"), *box(244, "trak"), *track, *box(144, "mdia"), *media, *box(72, "minf"), *box(64, "stbl"), *table)


@query("scan_video_container", with_views("ev", then="""SELECT event_id, CASE WHEN event_id % 10 NOT IN (4, 7) THEN CASE event_id % 2 WHEN 0 THEN 'riff' ELSE 'iso' END END AS container, CASE WHEN event_id % 10 NOT IN (4, 7) THEN CASE event_id % 2 WHEN 0 THEN 'H264' ELSE 'avc1' END END AS codec,
CASE WHEN event_id % 10 NOT IN (4, 7) THEN CAST(64 + event_id % 7 * 16 AS INTEGER) END AS width, CASE WHEN event_id % 10 NOT IN (4, 7) THEN CAST(48 + event_id % 5 * 16 AS INTEGER) END AS height, CASE WHEN event_id % 10 NOT IN (4, 7) THEN CAST(25 + event_id % 3 * 5 AS DOUBLE) END AS fps,
CASE WHEN event_id % 10 NOT IN (4, 7) THEN user_id + 1 END AS frames, CASE event_id % 10 WHEN 4 THEN 'unknown' WHEN 7 THEN 'truncated' END AS problem FROM ev"""))
def scan_video_container(spark, sf_dir):
    """Heads of video files made from the events, AVI and MP4 in turn; some broken off, some of no known kind."""
    i = F.col("event_id")
    facts = [64 + i % 7 * 16, 48 + i % 5 * 16, 25 + i % 3 * 5, F.col("user_id") + 1]
    head = F.when(i % 2 == 0, _container(*facts, little=True)).otherwise(_container(*facts, little=False))
    head = F.when(i % 10 == 4, F.repeat(F.lit("00"), 40)).when(i % 10 == 7, F.substring(head, 1, 300)).otherwise(head)
    return containers.container_facts(A.events(spark, sf_dir).select("event_id", F.unhex(head).alias("content")), "event_id", "content")
