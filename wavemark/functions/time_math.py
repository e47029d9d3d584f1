"""Time and range arithmetic as Column expressions. `round` means half to even unless it says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HOUR_US, MINUTE_US, SECOND_US = 3_600_000_000, 60_000_000, 1_000_000


def relative_time(t: Column, origin: Column) -> Column:
    return t - F.coalesce(origin, F.lit(0.0))


def absolute_time(t: Column, origin: Column) -> Column:
    return t + F.coalesce(origin, F.lit(0.0))


def floor_div(x: Column, by: int) -> Column:
    """Whole-number division that rounds down: the division left over is exact."""
    by_ = F.lit(by).cast("long")
    return ((x - F.pmod(x, by_)) / by_).cast("long")


def record_time_parts(us: Column) -> list[Column]:
    """Hours, minutes, seconds, microseconds; only the hours of a negative time are negative."""
    rest = F.pmod(us, F.lit(HOUR_US).cast("long"))
    minute, second = F.lit(MINUTE_US).cast("long"), F.lit(SECOND_US).cast("long")
    return [floor_div(us, HOUR_US), F.floor(rest / minute), F.floor(F.pmod(rest, minute) / second), F.pmod(us, second)]


def frame_to_time(frame: Column, fps: Column) -> Column:
    return F.when(F.coalesce(fps, F.lit(0.0)) != 0, frame / fps).otherwise(0.0)


def time_to_frame(t: Column, fps: Column, total: Column | None = None) -> Column:
    frame = F.rint(t * fps).cast("long")
    return frame if total is None else F.greatest(F.lit(0).cast("long"), F.least(frame, total - 1))


def parse_time(text: Column) -> Column:
    """Signed seconds, MM:SS or HH:MM:SS as decimal(28,9), below 10^13; null where the text is none of them."""
    value = F.trim(text)
    parts = F.split(F.regexp_replace(value, "^[+-]", ""), ":")
    numbers = F.transform(parts, lambda c: F.when(c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), c).try_cast("decimal(22,9)"))
    whole = F.aggregate(numbers, F.lit(0).cast("decimal(28,9)"), lambda sum_, x: (sum_ * F.lit(60).cast("decimal(2,0)") + x).cast("decimal(28,9)"))
    plain = F.forall(F.slice(numbers, 2, 3), lambda x: x < 60) & F.forall(numbers, lambda x: x >= 0) & (F.size(parts) <= 3)
    size = F.when((F.size(parts) == 1) | plain, whole)
    return F.when(value.startswith("-"), -size).otherwise(size)


def parse_record_us(text: Column) -> Column:
    """Microseconds of a time text, halves away from zero."""
    return F.round(parse_time(text) * F.lit(1_000_000).cast("decimal(7,0)"), 0).cast("long")


def format_time(t: Column) -> Column:
    """MM:SS.mmm with as many minute digits as it takes."""
    ms = F.rint(t * 1000).cast("long")
    rest = F.pmod(ms, F.lit(60_000).cast("long"))
    return F.format_string("%02d:%02d.%03d", floor_div(ms, 60_000), floor_div(rest, 1000), F.pmod(rest, F.lit(1000).cast("long")))


def format_display_time(t: Column) -> Column:
    return F.concat(F.when(t < 0, "-").otherwise(""), format_time(F.abs(t)))


def fixed(x: Column, digits: int) -> Column:
    """Text with so many decimals, rounded from the number's exact binary value (ties, which are rare there, to even).

    The product with the power of ten is taken with its rounding error (Dekker's splitting), so a number whose shortest
    text ends in 5 goes the way its binary value lies. Good below 2^53 / 10^digits; larger numbers are written as they are.
    """
    scale = float(10**digits)
    p, c = x * scale, x * 134217729.0
    high = c - (c - x)
    error = (high * scale - p) + (x - high) * scale
    whole = F.floor(p)
    rest = p - whole
    up = (rest > 0.5) | (rest == 0.5) & ((error > 0) | (error == 0) & (F.pmod(whole, F.lit(2).cast("long")) == 1))
    return F.when(F.abs(p) < 2.0**53, F.format_string(f"%.{digits}f", (whole + up.cast("long")) / scale)).otherwise(F.format_string(f"%.{digits}f", x))


def rounded(x: Column, digits: int) -> Column:
    """The number with so many decimals: its product with the power of ten rounded, halves away from zero, as SQL engines do.

    Spark's round goes by the number's shortest text instead, so a text that ends in 5 goes up wherever its value lies.
    """
    scale = float(10**digits)
    return F.round(x * scale) / scale


def format_tick(t: Column, origin: Column) -> Column:
    """No, one or two decimals from 100, from 10 and below."""
    x = relative_time(t, origin)
    v = F.when(F.abs(x) < 0.0005, 0.0).otherwise(x)
    return F.when(F.abs(v) >= 100, fixed(v, 0)).when(F.abs(v) >= 10, fixed(v, 1)).otherwise(fixed(v, 2))


def clamp_range(left: Column, right: Column, full_left: Column, full_right: Column) -> tuple[Column, Column]:
    """The window moved inside the full range without a change of width; the full range if it is no wider."""
    whole = (full_right - full_left <= 0) | (right - left >= full_right - full_left)
    r1 = F.when(left < full_left, right + (full_left - left)).otherwise(right)
    l1 = F.greatest(left, full_left)
    l2 = F.when(r1 > full_right, l1 - (r1 - full_right)).otherwise(l1)
    r2 = F.least(r1, full_right)
    return F.when(whole, full_left).otherwise(F.greatest(l2, full_left)), F.when(whole, full_right).otherwise(F.least(r2, full_right))


def follow_window(now: Column, left: Column, right: Column, full_left: Column, full_right: Column, *, default: float = 30.0, edge: float = 0.18, place: float = 0.35) -> tuple[Column, Column]:
    """The window that follows the cursor: moved when it comes near an edge, with the cursor at 35 % of the width."""
    full = full_right - full_left
    width = F.greatest(right - left, F.lit(1e-6))
    wide = width >= full * 0.98
    target = F.when(wide, F.least(F.lit(default), full)).otherwise(F.least(width, full))
    cursor = F.least(F.greatest(now, full_left), full_right)
    moved = (wide & (target < width)) | (cursor < left + target * edge) | (cursor > right - target * edge)
    begin = cursor - target * place
    a, b = clamp_range(begin, begin + target, full_left, full_right)
    to_left, to_right = (F.when(target >= full, f).when(moved, c).otherwise(o) for f, c, o in ((full_left, a, left), (full_right, b, right)))
    return F.when(full <= 0, left).otherwise(to_left), F.when(full <= 0, right).otherwise(to_right)


def plot_step(n: Column, step: Column) -> Column:
    """n // 5000 (1 at least) where no step is set, else the step; 0 means all."""
    return F.when(step.isNotNull(), F.greatest(step, F.lit(0)).cast("long")).otherwise(F.greatest(F.floor(n / 5000), F.lit(1).cast("long")))


def visible_step(n: Column, step: Column, width_px: Column, per_px: float = 2.0) -> Column:
    """ceil(n / (2 x pixels)) where no step is set; 0 counts as 1; negative steps are an error."""
    auto = F.greatest(F.ceil(F.greatest(n, F.lit(0).cast("long")) / F.greatest(F.floor(width_px * per_px), F.lit(1).cast("long"))), F.lit(1).cast("long"))
    bad = F.raise_error(F.lit("the plot step must be null, 0 or positive")).cast("long")
    return F.when(step.isNull(), auto).when(step == 0, F.lit(1).cast("long")).when(step > 0, step.cast("long")).otherwise(bad)


def coarse_scan_step(fps: Column) -> Column:
    return F.greatest(F.rint(fps * 2 / 3).cast("long"), F.lit(1).cast("long"))


def rotation(degrees: Column) -> Column:
    turned = F.pmod(degrees, F.lit(360).cast("long"))
    return F.when(turned.isin(0, 90, 180, 270), turned).otherwise(F.lit(0).cast("long"))


def harmonics(base: Column, nyquist: Column) -> Column:
    """All whole multiples of the base frequency under Nyquist; empty if there are none."""
    most = F.ceil(nyquist / base) - 1
    return F.when(most >= 1, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(most, F.lit(1).cast("long"))), lambda k: k * base)).otherwise(F.array().cast("array<double>"))


def decibels(power: Column, floor: float = 1.1754943508222875e-38) -> Column:
    """10 log10, the least positive single-precision number standing in for anything smaller."""
    return F.lit(10.0) * F.log10(F.greatest(power, F.lit(floor)))


def snap_position(t: Column, fps: Column, total: Column) -> tuple[Column, Column]:
    """(frame, time) of an edited time: the frame inside the video, and its time where the time isn't negative."""
    frame = time_to_frame(t, fps, total)
    return frame, F.when(t >= 0, frame / fps).otherwise(t)


def ordered_range(start: Column, end: Column, origin: Column) -> tuple[Column, Column]:
    a, b = absolute_time(start, origin), absolute_time(end, origin)
    return F.least(a, b), F.greatest(a, b)


def slider_range(left: Column, right: Column, full_left: Column, full_right: Column, least_width: Column) -> tuple[Column, Column]:
    """Clamped, widened to the least width, clamped again."""
    a, b = clamp_range(left, right, full_left, full_right)
    c, d = clamp_range(a, a + least_width, full_left, full_right)
    narrow = b - a < least_width
    return F.when(narrow, c).otherwise(a), F.when(narrow, d).otherwise(b)
