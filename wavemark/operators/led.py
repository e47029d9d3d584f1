"""Brightness curves: deltas, thresholds, on/off pairs, nearest points, greedy selection and refinement."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.time_math import coarse_scan_step
from .blocks import with_largest_before, with_latest, with_nearest, with_previous
from .dominance import select
from .windows import merge_ranges

LEAST = 1e-6
#: Frames of a curve that are compared in one task.
FRAMES = 100_000
#: United ranges that become conditions.
FEW_RANGES = 64


def frame_brightness(pixels: DataFrame) -> DataFrame:
    """Mean brightness (0 to 1) of each frame's pixels (frame_index, b, g, r), by the usual luma weights."""
    return pixels.groupBy("frame_index").agg((F.avg(0.114 * F.col("b") + 0.587 * F.col("g") + 0.299 * F.col("r")) / 255).alias("brightness"))


def _halved(x: np.ndarray) -> np.ndarray:
    """The picture (height, width, 3) at half its size: means of the areas that the smaller pixels cover, rounded to 8 bits.

    Even sides give means of two by two, halves rounded up; other sides cover parts of pixels, halves rounded to even.
    """
    (h, w), even = x.shape[:2], not (x.shape[0] % 2 or x.shape[1] % 2)
    if even:
        return (x.reshape(h // 2, 2, w // 2, 2, 3).astype(np.uint16).sum((1, 3)) + 2 >> 2).astype(np.uint8)

    def shares(n: int) -> np.ndarray:
        m = max(n // 2, 1)
        edges = np.arange(m + 1) * (n / m)
        return np.clip(np.minimum(edges[1:, None], np.arange(1, n + 1)) - np.maximum(edges[:-1, None], np.arange(n)), 0, 1) * (m / n)

    return np.rint(np.einsum("ah,bw,hwc->abc", shares(h), shares(w), x.astype(np.float64))).astype(np.uint8)


def mean_grey(frame: np.ndarray, roi: tuple[int, int, int, int] | None = None, rotation: int = 0) -> float:
    """Mean brightness (0 to 1) of a frame (height, width, blue green red): turned counterclockwise, cut to (x, y, width, height),
    halved and made grey in 8 bits. A region without pixels is dark."""
    x = np.rot90(frame, rotation // 90)
    if roi is not None:
        x = x[roi[1] : roi[1] + roi[3], roi[0] : roi[0] + roi[2]]
    if not x.size:
        return 0.0
    # Weights of blue, green and red in 14 bits, and the half that rounds.
    grey = _halved(x).astype(np.int64) @ np.array([1868, 9617, 4899]) + 8192 >> 14
    return float(grey.mean()) / 255


def brightness_curve(frames: DataFrame, *, roi: tuple[int, int, int, int] | None = None, rotation: int = 0, fps: float = 30.0, step: int = 1, start: int = 0, end: int | None = None) -> DataFrame:
    """frame_index, video_time_sec, brightness of every step-th frame from `start` to `end` (both included).

    `frames` has frame_index, width, height and pixels (binary, rows of blue, green, red bytes). A rotation that isn't a
    quarter turn counts as none. Frames without pixels, or with too few of them, are left out.
    """
    turn = rotation % 360 if rotation % 90 == 0 else 0
    at = F.col("frame_index")
    wanted = frames.where((at >= start) & ((at - start) % max(step, 1) == 0))
    wanted = wanted if end is None else wanted.where(at <= end)
    whole = wanted.where(F.length("pixels") == F.col("width") * F.col("height") * 3).where("width > 0 and height > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index = b.column(0).to_numpy()
            found = [mean_grey(np.frombuffer(p.as_py(), np.uint8).reshape(h, w, 3), roi, turn) for w, h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(index / fps), pa.array(found, pa.float64())], names=["frame_index", "video_time_sec", "brightness"])

    rows = whole.select(at.cast("long").alias("frame_index"), F.col("width").cast("int"), F.col("height").cast("int"), "pixels")
    return rows.mapInArrow(run, "frame_index long, video_time_sec double, brightness double")


def with_cache_key(df: DataFrame, *, path: Column, roi: Column, rotation: Column, fps: Column, start: Column, end: Column) -> DataFrame:
    """`key`: all that a curve was made from, the step of its coarse scan included."""
    parts = {"path": path, "roi": roi, "rotation": rotation.cast("int"), "fps": F.coalesce(fps.cast("double"), F.lit(0.0)), "start": start.cast("long"), "end": end.cast("long"), "step": coarse_scan_step(fps)}
    return df.withColumn("key", F.struct(*(c.alias(n) for n, c in parts.items())))


def cached(requests: DataFrame, curves: DataFrame) -> DataFrame:
    """The requests whose curve is there; a whole picture (no region) is a region of its own."""
    known = curves.select(F.col("key").alias("known")).distinct()
    return requests.join(known, F.col("key").eqNullSafe(F.col("known")), "left_semi")


def deltas(points: DataFrame, camera: list[str] = ()) -> DataFrame:
    """Change from the frame before, for all frames but the first (of each camera); put in order in blocks of frames."""
    rows = with_previous(points, F.col("brightness"), "_last", list(camera), "frame_index", FRAMES)
    return rows.withColumn("delta", F.col("brightness") - F.col("_last")).where("delta is not null").drop("_last", "_block")


def threshold(changes: DataFrame) -> DataFrame:
    """One row: three times the mean size of a change, 1e-6 at least."""
    return changes.agg(F.greatest(3 * F.avg(F.abs("delta")), F.lit(LEAST)).alias("threshold"))


def on_off_pairs(changes: DataFrame, least: DataFrame | float | None = None, *, camera: list[str] = (), shortest: float = 0.6, longest: float = 1.5, expected: float = 1.0, weight: float = 0.1) -> DataFrame:
    """Every rise and later fall over the threshold whose distance is a pulse's, with its score.

    `least` is the threshold, a table with the one row of it, or None where the changes have a column of it. A rise's
    partners are in its own or the next time bucket of the longest length, so an equal join on buckets (and cameras) finds
    them; falls aren't compared with rises elsewhere.
    """
    rows = changes if least is None else changes.crossJoin(F.broadcast(least)) if isinstance(least, DataFrame) else changes.withColumn("threshold", F.lit(least))
    bucket = F.floor(F.col("video_time_sec") / longest)
    on = rows.where("delta > threshold").select(*camera, "threshold", F.col("frame_index").alias("on_frame"), F.col("video_time_sec").alias("on_sec"), F.col("delta").alias("on_delta"), F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    off = rows.where("delta < -threshold").select(*camera, F.col("frame_index").alias("off_frame"), F.col("video_time_sec").alias("off_sec"), F.col("delta").alias("off_delta"), bucket.alias("bucket"))
    pairs = on.join(off, [*camera, "bucket"]).where("off_frame > on_frame").withColumn("duration_sec", F.col("off_sec") - F.col("on_sec")).where(F.col("duration_sec").between(shortest, longest))
    score = F.abs("on_delta") + F.abs("off_delta") - weight * F.abs(F.col("duration_sec") - expected)
    return pairs.select(*camera, "threshold", "on_frame", "off_frame", "on_sec", "off_sec", "duration_sec", score.alias("score"))


def choose_pairs(pairs: DataFrame, most: int, gap_frames: int, block: int = FRAMES // 10) -> list[tuple[int, int]]:
    """The best pairs in turn, none overlapping another's range widened by the gap; the first found wins ties.

    The first so many of all that a selection in turn takes are its best ones, so the pairs are chosen in blocks of
    frames (see `dominance`) and the best of the chosen ones are the answer.
    """
    rows = pairs.select("on_frame", "off_frame", "score")
    longest = rows.agg(F.max(F.col("off_frame") - F.col("on_frame"))).first()[0]
    if longest is None:
        return []
    chosen = select(rows, [], "on_frame", "off_frame", [("score", False), ("on_frame", True), ("off_frame", True)], gap=gap_frames, longest=longest, block=max(block, gap_frames + longest))
    return [(r.on_frame, r.off_frame) for r in chosen.orderBy(F.desc("score"), "on_frame", "off_frame").limit(most).collect()]


def nearest_points(queries: DataFrame, points: DataFrame, camera: list[str] = ()) -> DataFrame:
    """Each query frame's nearest point, the earlier one on ties: both tables in one order in blocks of frames, no join of ranges."""
    q = queries.select(*camera, F.col("frame_index").cast("long").alias("f"), F.col("query_id"), F.lit(None).cast("struct<frame_index: bigint, brightness: double>").alias("p"))
    p = points.select(*camera, F.col("frame_index").cast("long").alias("f"), F.lit(None).cast("long").alias("query_id"), F.struct(F.col("frame_index").cast("long").alias("frame_index"), "brightness").alias("p"))
    rows = with_nearest(q.unionByName(p), F.col("p"), "a", "b", list(camera), "f", FRAMES).where("query_id is not null")
    far = F.col("b").isNull() | (F.col("f") - F.col("a.frame_index") <= F.col("b.frame_index") - F.col("f"))
    best = F.when(F.col("a").isNotNull() & far, F.col("a")).otherwise(F.col("b"))
    return rows.select(*camera, "query_id", F.col("f").alias("query_frame"), best["frame_index"].alias("frame_index"), best["brightness"].alias("brightness"))


def outside_ranges(df: DataFrame, ranges: DataFrame | list[tuple[int, int]], start: Column, end: Column, few: int = FEW_RANGES, block: int = FRAMES) -> DataFrame:
    """Rows whose closed range meets none of the given closed ones (left, right); rows without both ends are left out.

    The ranges are united first, so that of those which begin no later than a row ends only the last can meet it. A few
    united ranges become conditions that a scan may take over; for more, rows and ranges are put in one order, in blocks.
    """
    spark = df.sparkSession
    given = ranges if isinstance(ranges, DataFrame) else spark.createDataFrame([(float(a), float(b)) for a, b in ranges], "left double, right double")
    united = merge_ranges(given.select(F.lit(0).alias("channel"), F.col("left").cast("double").alias("left"), F.col("right").cast("double").alias("right")).where("left <= right"), 0.0, block)
    first = united.select("left", "right").limit(few + 1).collect()
    if len(first) <= few:
        for a, b in first:
            df = df.where(~((start <= b) & (end >= a)))
        return df.where(start.isNotNull() & end.isNotNull())
    rows = df.where(start.isNotNull() & end.isNotNull()).select(end.cast("double").alias("_at"), start.cast("double").alias("_from"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), F.lit(None).cast("double").alias("_right"))
    marks = united.select(F.col("left").alias("_at"), F.lit(None).cast("double").alias("_from"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.col("right").alias("_right"))
    found = with_latest(rows.unionByName(marks), F.col("_right"), "_last", [], "_at", block).where("_row is not null and (_last is null or _last < _from)")
    return found.select("_row.*")


def detect(points: DataFrame, *, fps: float = 30.0, most: int = 1, gap_sec: float = 0.5) -> DataFrame:
    """led_on and led_off events (event_type, frame_index, video_time_sec, brightness) of the best pulses."""
    changes = deltas(points)
    pairs = choose_pairs(on_off_pairs(changes, threshold(changes)), most, max(int(gap_sec * fps), 1))
    frames = [(kind, f) for a, b in pairs for kind, f in (("led_on", a), ("led_off", b))]
    wanted = points.sparkSession.createDataFrame(frames, "event_type string, frame_index long")
    return points.join(F.broadcast(wanted), "frame_index").select("event_type", "frame_index", "video_time_sec", "brightness")


def refine(fine: DataFrame, coarse_events: DataFrame, *, fps: float = 30.0, window_sec: float = 1.0, gap_sec: float = 0.5) -> DataFrame:
    """The best pulse of the fine curve around each coarse on/off pair (pair_id, on_sec, off_sec); overlapping ones go.

    One row a pulse found: on_frame, off_frame, score, threshold. Nothing found means nothing returned.
    """
    spans = coarse_events.select("pair_id", (F.col("on_sec") - window_sec).alias("a"), (F.col("off_sec") + window_sec).alias("b"))
    width = 1.5 + 2 * window_sec  # a pulse's longest span: it lies in two buckets at most
    wanted = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor(F.col("b") / width))))
    inside = fine.withColumn("bucket", F.floor(F.col("video_time_sec") / width)).join(wanted, "bucket").where(F.col("video_time_sec").between(F.col("a"), F.col("b"))).drop("bucket", "a", "b")
    changes = deltas(inside, ["pair_id"])
    limits = changes.groupBy("pair_id").agg(F.greatest(3 * F.avg(F.abs("delta")), F.lit(LEAST)).alias("threshold"))
    pairs = on_off_pairs(changes.join(limits, "pair_id"), camera=["pair_id"])
    best = pairs.groupBy("pair_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "on_frame", "off_frame", "threshold")).alias("m"))
    found = best.select("pair_id", "m.on_frame", "m.off_frame", (-F.col("m.s")).alias("score"), "m.threshold")
    gap = max(int(gap_sec * fps), 1)
    rows = with_largest_before(found, "off_frame", "last", [], "on_frame", FRAMES, ("pair_id",)).drop("_block")
    return rows.where(F.col("last").isNull() | (F.col("on_frame") > F.col("last") + gap)).drop("last")
