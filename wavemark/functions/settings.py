"""Filter settings as columns: older ones brought up to date, rules, views, forms and descriptions.

Settings are one struct column. What a setting becomes is a list of (condition, value), of which the first that holds
counts; the texts of a description are such lists too.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import format_g6, parse_frequencies

#: The settings' names, types and defaults in project files.
FIELDS = {
    "show_filtered": ("boolean", False), "bandpass_enabled": ("boolean", False), "bandpass_low_hz": ("double", 1.0), "bandpass_high_hz": ("double", 100.0), "line_noise_hz": ("double", None),
    "notch_quality": ("double", 30.0), "line_noise_method": ("string", "notch"), "regression_window_seconds": ("double", 4.0), "regression_overlap": ("double", 0.5), "regression_harmonics": ("int", 1),
    "regression_all_harmonics": ("boolean", False), "line_noise_frequencies_hz": ("array<double>", None),
}
METHODS = ("none", "notch", "regression")
MOST_FREQUENCIES = 64
SCHEMA = ", ".join(f"{name} {kind}" for name, (kind, _) in FIELDS.items())


def first_of(*cases: tuple[Column, Column]) -> Column:
    """The value of the first condition that holds; null if none does."""
    out = F
    for holds, value in cases:
        out = out.when(holds, value)
    return out


def _struct(values: dict[str, Column]) -> Column:
    return F.struct(*(values[name].cast(kind).alias(name) for name, (kind, _) in FIELDS.items()))


def _no_hertz() -> Column:
    return F.array().cast("array<double>")


def migrate(text: Column, legacy_hz: Column | None = None) -> Column:
    """Settings of today from a JSON object that may be older; `legacy_hz` is the frequency that older projects kept beside it.

    Null text counts as an empty object. A value of another type than the setting's is null, and so breaks a rule.
    """
    json = F.coalesce(text, F.lit("{}"))
    given, names = F.from_json(json, SCHEMA), F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    yes = F.lit(True)

    def has(name: str) -> Column:
        return F.array_contains(names, name)

    values = {name: first_of((has(name), given[name]), (yes, F.lit(default).cast(kind))) for name, (kind, default) in FIELDS.items()}
    scalar = given["line_noise_hz"]
    old = F.lit(None).cast("double") if legacy_hz is None else legacy_hz.cast("double")
    alone = lambda x: F.when(x.isNull(), _no_hertz()).otherwise(F.array(x))
    hertz = first_of((given["line_noise_frequencies_hz"].isNotNull(), given["line_noise_frequencies_hz"]), (has("line_noise_hz"), alone(scalar)), (yes, alone(old)))
    hz = first_of((has("line_noise_hz"), scalar), (F.size(hertz) > 0, F.get(hertz, 0)), (yes, old))
    method = first_of((has("line_noise_method"), given["line_noise_method"]), (hz.isNotNull() | (F.size(hertz) > 0), F.lit("notch")), (yes, F.lit("none")))
    many = first_of((has("regression_all_harmonics"), given["regression_all_harmonics"]), (yes, F.coalesce(values["regression_harmonics"] > 1, F.lit(False))))
    return _struct(values | {"line_noise_frequencies_hz": hertz, "line_noise_hz": hz, "line_noise_method": method, "regression_all_harmonics": many})


def to_json(s: Column) -> Column:
    return F.to_json(s, {"ignoreNullFields": "false"})


def frequencies(s: Column) -> Column:
    """The listed frequencies, else the single one, else none."""
    return first_of((F.size(s["line_noise_frequencies_hz"]) > 0, s["line_noise_frequencies_hz"]), (F.coalesce(s["line_noise_hz"], F.lit(0.0)) != 0, F.array(s["line_noise_hz"])), (F.lit(True), _no_hertz()))


def problems(s: Column) -> Column:
    """Names of the rules that the settings break."""

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    hz = s["line_noise_frequencies_hz"]
    sound = hz.isNotNull() & (F.size(hz) <= MOST_FREQUENCIES) & ~F.exists(hz, lambda x: ~(finite(x) & (x > 0)))
    rules = {
        "method": s["line_noise_method"].isin(*METHODS),
        "frequencies": sound & ~(s["show_filtered"] & (s["line_noise_method"] != "none") & (F.size(hz) == 0)),
        "frequency": s["line_noise_hz"].isNull() | finite(s["line_noise_hz"]) & (s["line_noise_hz"] > 0),
        "quality": finite(s["notch_quality"]) & (s["notch_quality"] > 0),
        "window": finite(s["regression_window_seconds"]) & (s["regression_window_seconds"] > 0),
        "overlap": finite(s["regression_overlap"]) & (s["regression_overlap"] >= 0) & (s["regression_overlap"] < 1),
        "harmonics": s["regression_harmonics"] >= 1,
        "all harmonics": s["regression_all_harmonics"].isNotNull(),
    }
    return F.array_compact(F.array(*(F.when(~F.coalesce(holds, F.lit(False)), name) for name, holds in rules.items())))


def for_view(s: Column, filtered: Column) -> Column:
    """The settings as a view uses them: filtered or not, whatever they say."""
    return F.coalesce(s, migrate(F.lit("{}"))).withField("show_filtered", filtered)


def from_controls(*, filtered: Column, bandpass: Column, low_hz: Column, high_hz: Column, method: Column, frequency_text: Column, quality: Column, window_sec: Column, overlap_percent: Column, all_harmonics: Column) -> Column:
    """Settings of a form: no method has no frequencies, any other needs one; the overlap comes in percent."""
    hertz = F.when(method == "none", _no_hertz()).otherwise(parse_frequencies(frequency_text, MOST_FREQUENCIES))
    needed = F.when((method != "none") & (F.size(hertz) == 0), F.raise_error(F.lit("a frequency is needed")).cast("array<double>")).otherwise(hertz)
    return _struct({
        "show_filtered": filtered, "bandpass_enabled": bandpass, "bandpass_low_hz": low_hz, "bandpass_high_hz": high_hz, "line_noise_hz": F.get(needed, 0), "notch_quality": quality,
        "line_noise_method": method, "regression_window_seconds": window_sec, "regression_overlap": overlap_percent / 100, "regression_harmonics": F.lit(1),
        "regression_all_harmonics": all_harmonics, "line_noise_frequencies_hz": needed,
    })


def notch_options(s: Column) -> Column:
    """struct(frequencies_hz, quality_factor) that bridges notches in a displayed spectrum; null unless filtered by notches."""
    used = s["show_filtered"] & (s["line_noise_method"] == "notch") & (F.size(frequencies(s)) > 0)
    return F.when(used, F.struct(frequencies(s).alias("frequencies_hz"), s["notch_quality"].alias("quality_factor")))


def describe(s: Column) -> Column:
    """What is done to a signal, in words."""
    yes, hertz = F.lit(True), frequencies(s)
    lo, hi, listed = format_g6(s["bandpass_low_hz"]), format_g6(s["bandpass_high_hz"]), F.array_join(F.transform(hertz, format_g6), ", ")
    any_hz = F.size(hertz) > 0
    # The texts.
    band = first_of((s["bandpass_enabled"], F.format_string("bandpass %s-%s Hz", lo, hi)), (yes, F.format_string("bandpass off (low %s Hz, high %s Hz)", lo, hi)))
    many = first_of((s["regression_all_harmonics"] | (s["regression_harmonics"] > 1), F.lit("all harmonics below Nyquist")), (yes, F.lit("fundamental only")))
    regression = F.format_string("sinusoidal regression %s Hz, %s s, %s%% overlap, %s", listed, format_g6(s["regression_window_seconds"]), format_g6(s["regression_overlap"] * 100), many)
    noise = first_of((any_hz & (s["line_noise_method"] == "notch"), F.format_string("notch %s Hz (Q=%s)", listed, format_g6(s["notch_quality"]))), (any_hz & (s["line_noise_method"] == "regression"), regression), (yes, F.lit("line-noise removal off")))
    return first_of((~F.coalesce(s["show_filtered"], F.lit(False)), F.lit("Raw")), (yes, F.format_string("Filtered: %s, %s", band, noise)))
