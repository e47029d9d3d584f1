"""Marker tables: time domains, synchronisation, pairing, numbering, editing and peaks.

A marker has marker_id, seq (its place in the table), kind, source, domain (video or record), time_sec, frame_index, note.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import format_g6
from .blocks import ROWS, with_latest, with_number, with_previous

VIDEO_KINDS = ("led_on", "led_off", "action_start", "action_end", "seizure_like")


def number_rows(df: DataFrame, bucket: Column, order: list, name: str = "number", keys: tuple[str, ...] = ()) -> DataFrame:
    """Row numbers from 1 over the whole table (or each of `keys`) without one task for it: `bucket` must not fall along `order`.

    Rows are numbered within buckets; a bucket's offset is the count of the buckets before it, and only those counts
    (a row a bucket) meet in one window.
    """
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*keys, "_bucket", before.alias("_before"))
    inside = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)))
    return inside.join(starts, [*keys, "_bucket"]).withColumn(name, F.col("_before") + F.col("_k")).drop("_bucket", "_before", "_k")


def video_time(offset: Column) -> Column:
    return F.when(F.col("domain") == "video", F.col("time_sec")).otherwise(F.col("time_sec") + offset)


def record_time(offset: Column) -> Column:
    return F.when(F.col("domain") == "record", F.col("time_sec")).otherwise(F.col("time_sec") - offset)


def earliest(df: DataFrame) -> DataFrame:
    """kind, marker_id, time_sec of the earliest TTL and LED-on marker; the first in the table wins ties."""
    rows = df.where(((F.col("kind") == "ttl") & (F.col("domain") == "record")) | ((F.col("kind") == "led_on") & (F.col("domain") == "video")))
    first = F.min(F.struct("time_sec", "seq", "marker_id")).alias("m")
    return rows.groupBy("kind").agg(first).select("kind", "m.marker_id", "m.time_sec")


def sync(df: DataFrame, ttl_id: str | None = None, video_id: str | None = None) -> DataFrame:
    """One row: the reference pair and offset_sec = video - record; null where a reference is missing.

    Without ids the earliest TTL and LED-on are taken; with ids those markers, if they are of a kind that may serve.
    """
    ttl = (F.col("kind") == "ttl") & (F.col("domain") == "record")
    if ttl_id is None:
        video = (F.col("kind") == "led_on") & (F.col("domain") == "video")
    else:
        ttl, video = ttl & (F.col("marker_id") == ttl_id), F.col("kind").isin("led_on", "action_start") & (F.col("domain") == "video") & (F.col("marker_id") == video_id)
    pick = lambda c: F.min(F.when(c, F.struct("time_sec", "seq", "marker_id")))
    r = df.agg(pick(ttl).alias("t"), pick(video).alias("v"))
    return r.select(F.col("t.marker_id").alias("ttl_id"), F.col("v.marker_id").alias("video_id"), (F.col("v.time_sec") - F.col("t.time_sec")).alias("offset_sec"), F.col("v.time_sec").alias("video_origin_sec"))


#: How the kinds that may serve as a video reference are shown.
SYNC_LABELS = {"led_on": "LED On", "action_start": "Action Start"}


def sync_status(df: DataFrame, ttl_id: str | None = None, video_id: str | None = None) -> DataFrame:
    """One row: is_manual, label, is_warning. Ids make it the manual pair; a TTL's number is its rank in time, a video
    marker's its place among all video markers.

    Two counts over the table decide the numbers, so nothing is numbered as a whole. Equal times go by place.
    """
    manual = ttl_id is not None or video_id is not None
    ttl = (F.col("kind") == "ttl") & (F.col("domain") == "record")
    video = (F.col("domain") == "video") & (F.col("kind").isin(*SYNC_LABELS) & (F.col("marker_id") == video_id) if manual else F.col("kind") == "led_on")
    pick = lambda c: F.min(F.when(c, F.struct("time_sec", "seq", "kind")))
    pair = df.agg(pick(ttl & (F.col("marker_id") == ttl_id) if manual else ttl).alias("t"), pick(video).alias("v"))
    both = df.crossJoin(F.broadcast(pair))
    earlier = (F.col("time_sec") < F.col("t.time_sec")) | (F.col("time_sec") == F.col("t.time_sec")) & (F.col("seq") <= F.col("t.seq"))
    r = both.agg(F.count_if(ttl & earlier).alias("t_no"), F.count_if((F.col("domain") == "video") & (F.col("seq") <= F.col("v.seq"))).alias("v_no"), F.first("t").alias("t"), F.first("v").alias("v"))
    missing = F.col("t").isNull() | F.col("v").isNull()
    name = F.create_map(*(F.lit(x) for kv in SYNC_LABELS.items() for x in kv))[F.col("v.kind")]
    # The texts.
    found = F.format_string("Sync: " + ("Manual" if manual else "Automatic") + " (TTL #%d <-> Video #%d %s)", F.col("t_no"), F.col("v_no"), name)
    lost = "Manual sync selection is no longer available. Select sync events again." if manual else "Sync: Automatic selection needs a TTL and an LED On."
    return r.select(F.lit(manual).alias("is_manual"), F.when(missing, lost).otherwise(found).alias("label"), (missing & F.lit(manual)).alias("is_warning"))


def with_offset(df: DataFrame, one: DataFrame) -> DataFrame:
    """Every row with the one row of the synchronisation, which is broadcast."""
    return df.crossJoin(F.broadcast(one.select("offset_sec", "video_origin_sec")))


def pair_intervals(df: DataFrame, start_kind: str, end_kind: str, session: str = "user_id", block: int = ROWS) -> DataFrame:
    """Starts and ends of a session paired in table order: the latest start counts, the first later-timed end closes it.

    An end that isn't later leaves the start open; so of the ends after one start (and before the next) the first with a
    greater time is its partner, which needs the latest start of each row and a grouping but no fold. A session is put in
    order in blocks of its places, so a long one is no task of its own.
    """
    rows = df.where(F.col("kind").isin(start_kind, end_kind)).select(session, "seq", "kind", "time_sec", "marker_id")
    start = F.when(F.col("kind") == start_kind, F.struct("seq", "time_sec", "marker_id"))
    ends = with_latest(rows, start, "s", [session], "seq", block).where((F.col("kind") == end_kind) & (F.col("time_sec") > F.col("s.time_sec")))
    first = ends.groupBy(session, "s").agg(F.min(F.struct("seq", "time_sec", "marker_id")).alias("e"))
    return first.select(session, F.col("s.marker_id").alias("start_marker_id"), F.col("e.marker_id").alias("end_marker_id"), F.col("s.time_sec").alias("start_sec"), F.col("e.time_sec").alias("end_sec"))


def interval_warning(df: DataFrame, session: str = "user_id", block: int = ROWS) -> DataFrame:
    """session, number, problem: the first LED or action end without an open start, or not after it; numbers count video markers.

    Unlike pairing, only up to the first violation matters, so before it every end closes its start.
    """
    rows = df.where("domain = 'video'").select(session, "seq", "kind", "time_sec")
    rows = with_number(rows, "number", "_count", [session], "seq", block).drop("_count").withColumn("number", F.col("number") + 1)
    rows = rows.where(F.col("kind").isin(*VIDEO_KINDS[:4])).withColumn("pair", F.when(F.col("kind").startswith("led"), "led").otherwise("action"))
    rows = with_previous(rows, F.struct("kind", "time_sec", "number"), "before", [session, "pair"], "seq", block).drop("_block")
    is_end = F.col("kind").isin("led_off", "action_end")
    orphan = is_end & (F.col("before").isNull() | F.col("before.kind").isin("led_off", "action_end"))
    late = is_end & ~orphan & (F.col("time_sec") <= F.col("before.time_sec"))
    bad = rows.withColumn("problem", F.when(orphan, F.concat(F.col("kind"), F.lit(" has no start"))).when(late, F.concat(F.col("kind"), F.lit(" isn't after #"), F.col("before.number"))))
    return bad.where("problem is not null").groupBy(session).agg(F.min(F.struct("number", "problem")).alias("m")).select(session, F.col("m.number").cast("long").alias("number"), "m.problem")


def event_intervals(df: DataFrame, one: DataFrame, session: str = "user_id") -> DataFrame:
    """TTL points, action and LED intervals and seizure points in record time; nothing while unsynchronised."""
    ttl = with_offset(df.where("kind = 'ttl'"), one).select(F.lit("ttl").alias("event_type"), record_time(F.col("offset_sec")).alias("start_sec"), F.lit(None).cast("double").alias("end_sec"), F.col("marker_id").alias("start_marker_id"), F.lit(None).cast("string").alias("end_marker_id"), "offset_sec")
    parts = [ttl]
    for kind, a, b in (("action", "action_start", "action_end"), ("led", "led_on", "led_off")):
        p = with_offset(pair_intervals(df, a, b, session), one)
        parts.append(p.select(F.lit(kind).alias("event_type"), (F.col("start_sec") - F.col("offset_sec")).alias("start_sec"), (F.col("end_sec") - F.col("offset_sec")).alias("end_sec"), "start_marker_id", "end_marker_id", "offset_sec"))
    points = with_offset(df.where("kind = 'seizure_like'"), one)
    parts.append(points.select(F.lit("seizure_like").alias("event_type"), record_time(F.col("offset_sec")).alias("start_sec"), F.lit(None).cast("double").alias("end_sec"), F.col("marker_id").alias("start_marker_id"), F.lit(None).cast("string").alias("end_marker_id"), "offset_sec"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("offset_sec is not null").drop("offset_sec")


def exportable(df: DataFrame, one: DataFrame, fps: float) -> DataFrame:
    """Rows that have a video time, with a frame: their own, else the nearest one of the time (half to even)."""
    t = video_time(F.col("offset_sec"))
    rows = with_offset(df, one).withColumn("video_time_sec", t).where("video_time_sec is not null")
    return rows.select("seq", F.col("kind").alias("marker_type"), "video_time_sec", F.coalesce("frame_index", F.rint(F.col("video_time_sec") * fps).cast("long")).alias("frame_index"), "note")


def is_negative(negative: Column, value: Column) -> Column:
    """Stored polarity, else the value's sign, else not negative."""
    return F.coalesce(negative, value < 0, F.lit(False))


def sort_peaks(df: DataFrame, *, channel: int | None = None, polarity: str = "all", by: str = "time", descending: bool = False) -> DataFrame:
    """Filter and order of the peak table; missing keys count as +inf and equal keys keep table order in both directions."""
    rows = df if channel is None else df.where(F.col("channel") == channel)
    if polarity != "all":
        rows = rows.where(is_negative(F.col("negative"), F.col("value")) == (polarity == "negative"))
    key = F.coalesce(F.col("value" if by == "value" else "time_sec"), F.lit(float("inf")))
    return rows.withColumn("_key", key).orderBy(F.desc("_key") if descending else F.asc("_key"), "seq").drop("_key")


def peak_note(channel: Column, value: Column, negative: Column) -> Column:
    return F.concat(F.lit("channel="), channel.cast("string"), F.lit(", value="), format_g6(value), F.when(negative, ", negative peak").otherwise(", positive peak"))


def peaks_per_minute(df: DataFrame) -> DataFrame:
    """Peaks per channel and minute (rounded down, so times under zero have negative minutes); empty minutes are absent."""
    return df.where("time_sec is not null").groupBy("channel", F.floor(F.col("time_sec") / 60).alias("minute")).agg(F.count("*").alias("n"))


def overlay(line: DataFrame, exact: DataFrame) -> DataFrame:
    """Two series (channel, time_us, value) in one; where times are equal the exact one wins."""
    both = line.withColumn("rank", F.lit(0)).unionByName(exact.withColumn("rank", F.lit(1)))
    best = F.row_number().over(Window.partitionBy("channel", "time_us").orderBy(F.desc("rank"), "value"))
    return both.withColumn("k", best).where("k = 1").select("channel", "time_us", "value", (F.col("rank") == 1).alias("is_exact"))


def replace_where(df: DataFrame, old: Column, new: DataFrame) -> DataFrame:
    """The table without the rows of `old`, the new rows appended after its last place."""
    last = df.agg(F.max("seq").alias("last_seq"))
    moved = new.crossJoin(F.broadcast(last)).withColumn("seq", F.coalesce(F.col("last_seq"), F.lit(0)) + 1 + F.col("seq")).drop("last_seq")
    return df.where(~F.coalesce(old, F.lit(False))).unionByName(moved)


def update_where(df: DataFrame, which: Column, **values: Column) -> DataFrame:
    for name, value in values.items():
        df = df.withColumn(name, F.when(which, value).otherwise(F.col(name)))
    return df


def reorder(df: DataFrame, marker_id: str, number: int, session: str, block: int = ROWS) -> DataFrame:
    """The marker moved to the given place among its session's video markers; other kinds of rows keep their slots.

    Slots (seq values) of the video markers stay the same set; the markers move along them. Only the rows between the old
    and the new place move, by one slot each.
    """
    video = with_number(df.where("domain = 'video'"), "n", "count", [session], "seq", block).withColumn("n", F.col("n") + 1)
    moved = video.where(F.col("marker_id") == marker_id).groupBy(session).agg(F.max("n").alias("old"), F.least(F.lit(number), F.max("count")).alias("to"))
    rows = video.join(F.broadcast(moved), session, "left")  # a row a session that has the marker, one as ids differ
    n, a, b = F.col("n"), F.col("old"), F.col("to")
    place = F.when(a.isNull(), n).when(n == a, b).when((a < b) & (n > a) & (n <= b), n - 1).when((a > b) & (n >= b) & (n < a), n + 1).otherwise(n)
    slots = video.select(F.col(session).alias("_s"), n.alias("_n"), F.col("seq").alias("_seq"))
    placed = rows.withColumn("place", place).join(slots, (F.col(session) == F.col("_s")) & (F.col("place") == F.col("_n"))).withColumn("seq", F.col("_seq"))
    return placed.select(*df.columns).unionByName(df.where("domain <> 'video'"))
