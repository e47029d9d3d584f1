"""Text, array, JSON and naming functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .time_math import fixed

#: Spellings of the microvolt with blanks taken out and in lower case (micro sign, Greek mu, letter u).
MICROVOLT = ("uv", "µv", "μv")


def normalize_unit(unit: Column) -> Column:
    return F.when(F.replace(F.lower(unit), F.lit(" "), F.lit("")).isin(*MICROVOLT), "uV").otherwise(F.trim(F.regexp_replace(unit, r"\s+", " ")))


def parse_frequencies(text: Column, most: int = 64) -> Column:
    """Positive finite numbers between commas, semicolons and blanks, each once, as first seen; anything else is an error."""
    parts = F.filter(F.split(text, r"[,;\s]+"), lambda x: x != "")
    numbers = F.transform(parts, lambda x: x.try_cast("double"))
    bad = F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (x <= 0) | (x == float("inf"))) | (F.size(parts) > most)
    return F.when(bad, F.raise_error(F.lit("frequencies must be positive finite numbers, 64 at most")).cast("array<double>")).otherwise(F.array_distinct(numbers))


def signal_label(unit: Column) -> Column:
    return F.when(F.coalesce(unit, F.lit("")) == "", "Signal").otherwise(F.concat(F.lit("Signal ("), unit, F.lit(")")))


def channel_label(ordinal: Column, channels: Column, name: Column) -> Column:
    """Column 0 is the time, then one column a channel, shown by its id; others keep their own name."""
    found = F.get(channels, ordinal.cast("int") - 1)
    return F.when(ordinal == 0, "Time[us]").otherwise(F.coalesce(found.cast("string"), name))


def fourcc(value: Column) -> Column:
    """Four characters, lowest byte first, without blanks around them; `unknown` where nothing is left."""
    code = F.concat(*(F.char(F.shiftright(value, 8 * k).bitwiseAND(F.lit(255).cast("long"))) for k in range(4)))
    return F.when(value == 0, "unknown").otherwise(F.coalesce(F.nullif(F.regexp_replace(code, r"^\s+|\s+$", ""), F.lit("")), F.lit("unknown")))


def marker_to_json() -> Column:
    """The row's marker as JSON with a tagged position; whole microseconds keep the text free of float noise."""
    position = F.struct("domain", F.rint(F.col("time_sec") * 1e6).cast("long").alias("time_us"), "frame_index")
    return F.to_json(F.struct("marker_id", "kind", "source", position.alias("position"), "note"))


def marker_from_json(json: Column) -> Column:
    """Inverse of marker_to_json; a domain that isn't known is the video's, a missing note is empty."""
    found = F.from_json(json, "marker_id string, kind string, source string, position struct<domain: string, time_us: bigint, frame_index: bigint>, note string")
    domain = F.when(found["position"]["domain"] == "record", "record").otherwise("video")
    return F.struct(found["marker_id"].alias("marker_id"), found["kind"].alias("kind"), domain.alias("domain"), found["position"]["time_us"].alias("time_us"), found["position"]["frame_index"].alias("frame_index"), F.coalesce(found["note"], F.lit("")).alias("note"))


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^.*[/\\\\]", ""), "\\.[^.]*$", "")


def report_name(path: Column) -> Column:
    return F.concat(F.lit("output_data/"), _stem(path), F.lit("_check_report.csv"))


def image_name(path: Column, channel: Column, filtered: Column, suffix: Column) -> Column:
    """The recording's name, the channel, whether it is filtered, and a suffix if there is one."""
    parts = (_stem(path), F.lit("channel"), channel.cast("string"), F.when(filtered, "filtered").otherwise("raw"), F.nullif(suffix, F.lit("")))
    return F.concat(F.concat_ws("_", *parts), F.lit(".png"))


def format_g6(x: Column) -> Column:
    """Six significant digits without trailing zeros, as %.6g writes them."""
    e = F.floor(F.log10(F.abs(x)))
    digits = F.greatest(F.lit(0), 5 - e)
    text = fixed(x, 0)
    for k in range(1, 10):
        text = F.when(digits == k, fixed(x, k)).otherwise(text)
    plain = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    science = F.regexp_replace(F.regexp_replace(F.format_string("%.5e", x), r"(\.\d*?)0+e", "$1e"), r"\.e", "e")
    return F.when(x == 0, "0").when((e >= -4) & (e < 6), plain).otherwise(science)


#: Parts of a status line that its short form keeps, and how many it has at most.
SHOWN, MOST_SHOWN = ("interval", "scan frames=", "points=", "requested=", "threshold=", "duration=", "scan=", "brightness="), 8


def led_status(stats: dict[str, Column]) -> Column:
    """A detection's status line from its figures; figures that are null or left out take their defaults.

    Of the parts that belong to a brightness backend those of the one that ran are there, none if that isn't known.
    """
    n = stats["event_count"]

    def of(name: str, default: object, shape: str = "%d") -> Column:
        kind = "double" if "f" in shape else "string" if "s" in shape else "long"
        value = F.coalesce(*(x.cast(kind) for x in (stats.get(name), default if isinstance(default, Column) else F.lit(default)) if x is not None))
        return fixed(value, int(shape[2])) if kind == "double" else value.cast("string")

    backend = F.coalesce(stats.get("brightness_backend", F.lit(None).cast("string")), F.lit(""))
    # The texts, and the defaults of the figures.
    start = F.when(F.coalesce(stats.get("scan_outcome", F.lit("")), F.lit("")) == "no_events", "LED detection completed: no events found").otherwise("LED detection")
    opencl = F.concat_ws(" | ", F.lit("brightness=OpenCL"), F.concat(F.lit("selected="), of("opencl_selected_reason", "auto", "%s")), F.concat(F.lit("batch="), of("opencl_batch_mode", "fixed", "%s")), F.concat(F.lit("capacity="), of("opencl_batch_capacity", 0)), F.concat(F.lit("batches="), of("opencl_batches", 0)), F.concat(F.lit("max_batch="), of("opencl_max_batch_frames", 0)))
    return F.concat_ws(
        " | ",
        F.concat(start, F.lit(": "), of("mode_label", "Frame delta", "%s")),
        F.format_string("%d intervals", n.cast("long")),
        F.concat(F.lit("scan frames="), of("scan_start_frame", 0), F.lit("-"), of("scan_end_frame", 0)),
        F.concat(F.lit("coarse step="), of("coarse_step", 20), F.lit(" frames")),
        F.concat(F.lit("refine window="), of("refine_window_sec", 1.0, "%.1f"), F.lit("s")),
        F.concat(F.lit("points="), of("points_count", 0)),
        F.lit("TTL-guided event limit"),
        F.concat(F.lit("requested="), of("requested_event_count", n)),
        F.concat(F.lit("threshold="), of("threshold", 0.0, "%.6f")),
        F.concat(F.lit("duration="), of("min_duration_sec", 0.6, "%.1f"), F.lit("-"), of("max_duration_sec", 1.5, "%.1f"), F.lit("s target="), of("expected_duration_sec", 1.0, "%.1f"), F.lit("s")),
        F.when(n != 0, F.format_string("event pairs=%d", n.cast("long"))).otherwise("no LED event selected"),
        F.concat(F.lit("scan="), of("scan_elapsed_sec", 0.0, "%.1f"), F.lit("s detect="), of("detect_elapsed_sec", 0.0, "%.1f"), F.lit("s")),
        F.when(backend == "opencl", opencl).when(backend == "cpu", "brightness=CPU"),
    )


def short_status(status: Column) -> Column:
    """The first part of a status line and those of the others that are shown in short, eight in all at most."""
    parts = F.split(status, r" \| ")
    kept = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.rlike("|".join(SHOWN)))
    return F.when(F.coalesce(status, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.slice(F.concat(F.slice(parts, 1, 1), kept), 1, MOST_SHOWN))
