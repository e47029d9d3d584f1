"""A video's facts as columns, and the region of interest that a drag on its picture selects."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import fourcc


def metadata(path: Column, width: Column, height: Column, fps: Column, frames: Column, codec: Column, using_fps: float | None = None) -> dict[str, Column]:
    """What a decoder tells (missing facts are 0), and the rate to be used: the given one, else the detected one, else 30.

    Without a given rate the duration is that at the detected rate, which is 0 where none was detected.
    """
    found = F.coalesce(fps.cast("double"), F.lit(0.0))
    n = F.coalesce(frames.cast("long"), F.lit(0).cast("long"))
    own = F.when(found != 0, n / found).otherwise(0.0)
    name = F.regexp_replace(path, "^.*[/\\\\]", "")
    return {
        "filename": name,
        "file_format": F.lower(F.regexp_extract(name, r"[^.]\.([^.]*)$", 1)),
        "codec": fourcc(F.coalesce(codec.cast("long"), F.lit(0).cast("long"))),
        "width": F.coalesce(width.cast("int"), F.lit(0)),
        "height": F.coalesce(height.cast("int"), F.lit(0)),
        "detected_fps": found,
        "using_fps": F.lit(float(using_fps)) if using_fps is not None else F.when(found > 0, found).otherwise(30.0),
        "total_frames": n,
        "detected_duration_sec": own,
        "duration_sec": own if using_fps is None else n / F.lit(float(using_fps)) if using_fps else own,
    }


def _span(a: Column, b: Column) -> tuple[Column, Column]:
    """First and last pixel of a drag from a to b: dragged backwards, it ends a pixel before where it began."""
    back = b < a - 1
    return F.when(back, b + 1).otherwise(a), F.when(back, a - 1).otherwise(b)


def dragged_roi(start: tuple[Column, Column], end: tuple[Column, Column], shown: tuple[Column, Column, Column, Column], frame: tuple[Column, Column], least: int = 3) -> Column:
    """struct(x, y, width, height) in the frame's pixels of a drag over the picture shown at (x, y, width, height).

    The rectangle is cut to the picture; one under `least` pixels wide or high there selects nothing (null).
    """
    places = []
    for k in (0, 1):
        a, b = _span(start[k], end[k])
        a, b = F.greatest(a, shown[k]), F.least(b, shown[k] + shown[k + 2] - 1)
        places.append((a, F.greatest(b - a + 1, F.lit(0)), frame[k] / shown[k + 2]))
    (x, w, sx), (y, h, sy) = places
    whole = F.struct(((x - shown[0]) * sx).cast("int").alias("x"), ((y - shown[1]) * sy).cast("int").alias("y"), (w * sx).cast("int").alias("width"), (h * sy).cast("int").alias("height"))
    return F.when((w >= least) & (h >= least), whole)
