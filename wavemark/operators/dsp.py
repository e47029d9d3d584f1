"""Numeric kernels of the filters, spectra and peaks; NumPy alone, no Spark.

Recursions run over pieces of the signal side by side: all pieces are filtered from rest at once, the states at the
pieces' starts follow from each other by a small matrix, and the states' own responses are added.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

MOST_REGRESSED = 256


@dataclass(frozen=True)
class Settings:
    """What to filter: band-pass, then notches or a regression of sinusoids. Nothing is done unless show_filtered."""

    show_filtered: bool = False
    bandpass: bool = False
    low_hz: float = 1.0
    high_hz: float = 100.0
    method: str = "none"  # none, notch, regression
    frequencies: tuple[float, ...] = field(default=())
    quality: float = 30.0
    window_sec: float = 4.0
    overlap: float = 0.5
    all_harmonics: bool = False


def validate(s: Settings, rate_hz: float) -> None:
    """Rules across fields; a ValueError names the first that is broken."""
    nyquist = rate_hz / 2
    if not (math.isfinite(rate_hz) and rate_hz > 0):
        raise ValueError("the sample rate must be positive")
    if s.method not in ("none", "notch", "regression"):
        raise ValueError(f"unknown method {s.method}")
    if s.bandpass and not 0 < s.low_hz < s.high_hz < nyquist:
        raise ValueError("the band must lie between 0 and Nyquist, low before high")
    if s.method == "regression" and not s.frequencies:
        raise ValueError("regression needs a frequency")
    if any(not 0 < f < nyquist for f in s.frequencies):
        raise ValueError("frequencies must lie between 0 and Nyquist")
    if s.quality <= 0 or s.window_sec <= 0 or not 0 <= s.overlap < 1:
        raise ValueError("quality and window must be positive, the overlap in [0, 1)")


def padding(s: Settings | None, rate_hz: float) -> int:
    """Samples of context on each side of a block."""
    if s is None or not s.show_filtered:
        return 0
    least, active = 0, []
    if s.bandpass:
        active.append(s.low_hz)
        least = 27
    if s.method == "notch" and s.frequencies:
        active += s.frequencies
        least = max(least, 9)
    if s.method == "regression":
        least = max(least, round(s.window_sec * rate_hz))
    return max(least, math.ceil(3 * rate_hz / min(active))) if active else least


def fill_gaps(x: np.ndarray) -> np.ndarray:
    """Values that aren't finite become linear in the index; 0 where nothing is finite."""
    x = np.asarray(x, np.float64)
    good = np.isfinite(x)
    if good.all():
        return x.copy()
    return np.interp(np.arange(len(x)), np.flatnonzero(good), x[good]) if good.any() else np.zeros(len(x))


Sections = list[tuple[np.ndarray, np.ndarray]]


def through(x: np.ndarray, sections: Sections, states: np.ndarray) -> np.ndarray:
    """Second-order sections in turn from the given states (two delayed values each).

    Pieces of the signal lie side by side and take a step of every section at a time, all from rest. Beside them runs an
    input of nothing from each unit state: what it gives is added for the states in which the pieces really start.
    """
    n, size = len(x), 2 * len(sections)
    piece = max(16, int(math.sqrt(n) / 3))
    rows = -(-n // piece)
    padded = np.zeros(rows * piece)
    padded[:n] = x
    pieces = np.zeros((piece, rows + size))
    pieces[:, :rows] = padded.reshape(rows, piece).T
    z = np.zeros((size, rows + size))
    z[:, rows:] = np.eye(size)
    out, y, part = np.empty((piece, rows + size)), np.empty((len(sections), rows + size)), np.empty(rows + size)
    for k in range(piece):
        v = pieces[k]
        for j, (b, a) in enumerate(sections):
            one, two, w = z[2 * j], z[2 * j + 1], y[j] if j + 1 < len(sections) else out[k]
            np.multiply(v, b[0], out=w)
            w += one
            np.multiply(w, -a[1], out=one)
            one += two
            if b[1]:
                one += np.multiply(v, b[1], out=part)
            np.multiply(w, -a[2], out=two)
            if b[2]:
                two += np.multiply(v, b[2], out=part)
            v = w
    carry, at, starts = z[:, rows:], np.asarray(states, np.float64).ravel(), np.empty((rows, size))
    for r, rest in enumerate(z[:, :rows].T):
        starts[r] = at
        at = carry @ at + rest
    whole = out[:, :rows] + out[:, rows:] @ starts.T
    return whole.T.ravel()[:n]


def biquad(x: np.ndarray, b: np.ndarray, a: np.ndarray, state: np.ndarray) -> np.ndarray:
    """A second-order section from the given state (two delayed values)."""
    return through(x, [(b, a)], state)


def steady(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The state in which a constant input of 1 gives a constant output."""
    gain = b.sum() / a.sum()
    return np.array([b[1] - a[1] * gain + b[2] - a[2] * gain, b[2] - a[2] * gain])


def cascade(x: np.ndarray, sections: Sections, first: float | None = None) -> np.ndarray:
    """Sections in turn; with `first`, from the steady state of that constant input."""
    states, level = np.zeros((len(sections), 2)), first
    for k, (b, a) in enumerate(sections):
        if level is not None:
            states[k] = steady(b, a) * level
            level = level * b.sum() / a.sum()
    return through(x, sections, states)


def zero_phase(x: np.ndarray, sections: Sections, edge: int) -> np.ndarray:
    """Forward and backward over a signal that is continued by point reflection at both ends."""
    n = len(x)
    if n < 2:
        return x.copy()
    if n <= edge:
        return cascade(x, sections)
    long = np.concatenate((2 * x[0] - x[edge:0:-1], x, 2 * x[-1] - x[-2 : -edge - 2 : -1]))
    forward = cascade(long, sections, long[0])
    back = cascade(forward[::-1], sections, forward[-1])
    return back[::-1][edge : edge + n]


def bandpass_sections(low_hz: float, high_hz: float, rate_hz: float, order: int = 4) -> Sections:
    """Butterworth band-pass: analogue prototype, band transform, bilinear transform with prewarped edges."""
    lo, hi = (2 * rate_hz * math.tan(math.pi * f / rate_hz) for f in (low_hz, high_hz))
    width, centre = hi - lo, math.sqrt(lo * hi)
    prototype = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    half = prototype * width / 2
    root = np.sqrt(half**2 - centre**2)
    poles = np.concatenate((half + root, half - root))
    double = 2 * rate_hz
    digital = (double + poles) / (double - poles)
    gain = (width**order * double**order / np.prod(double - poles)).real
    upper = digital[digital.imag > 0]
    out = [(np.array([1.0, 0.0, -1.0]), np.array([1.0, -2 * p.real, abs(p) ** 2])) for p in sorted(upper, key=abs)]
    out[0] = (out[0][0] * gain, out[0][1])
    return out


def notch_section(hz: float, quality: float, rate_hz: float) -> Sections:
    """Second-order notch; quality is the centre over the width at half power."""
    w = 2 * math.pi * hz / rate_hz
    gain = 1 / (1 + math.tan(w / quality / 2))
    return [(gain * np.array([1.0, -2 * math.cos(w), 1.0]), np.array([1.0, -2 * gain * math.cos(w), 2 * gain - 1]))]


def bandpass(x: np.ndarray, rate_hz: float, low_hz: float, high_hz: float) -> np.ndarray:
    return zero_phase(x, bandpass_sections(low_hz, high_hz, rate_hz), 27)


def notch(x: np.ndarray, rate_hz: float, hz: float, quality: float) -> np.ndarray:
    return zero_phase(x, notch_section(hz, quality, rate_hz), 9)


def regressed_frequencies(s: Settings, rate_hz: float) -> list[float]:
    """The base frequencies, with all their multiples under Nyquist if asked, each once to 12 decimals."""
    validate(s, rate_hz)
    nyquist, found = rate_hz / 2, {}
    for base in s.frequencies:
        most = int(math.nextafter(nyquist, 0) // base) if s.all_harmonics else 1
        for k in range(1, most + 1):
            if base * k < nyquist:
                found.setdefault(round(base * k, 12), base * k)
    if len(found) > MOST_REGRESSED:
        raise ValueError(f"more than {MOST_REGRESSED} frequencies")
    return list(found.values())


def window_shape(s: Settings, rate_hz: float) -> tuple[int, int]:
    """(samples of a window, samples from one to the next)."""
    n = round(s.window_sec * rate_hz)
    return n, max(round(n * (1 - s.overlap)), 1)


def _design(n: int, rate_hz: float, frequencies: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(waves, design) of n samples: sines and cosines of the frequencies, and these with a constant and a trend."""
    t = 2 * np.pi * np.arange(n)[:, None] / rate_hz * np.array(frequencies)
    waves = np.concatenate((np.sin(t), np.cos(t)), 1)
    return waves, np.concatenate((waves, np.ones((n, 1)), np.linspace(-1, 1, n)[:, None]), 1)


@lru_cache(maxsize=8)
def _solved(n: int, rate_hz: float, frequencies: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(waves, what gives their weights from n samples): the same for every whole window, so solved once."""
    waves, design = _design(n, rate_hz, frequencies)
    return waves, np.linalg.pinv(design)[: waves.shape[1]]


def sinusoids(x: np.ndarray, rate_hz: float, frequencies: list[float]) -> np.ndarray:
    """The least-squares part of x in sines and cosines of the frequencies, fitted along with a constant and a trend."""
    waves, design = _design(len(x), rate_hz, tuple(frequencies))
    return waves @ np.linalg.lstsq(design, x, rcond=None)[0][: waves.shape[1]]


#: Whole windows that are solved by one product of matrices.
TOGETHER = 256


def without_sinusoids(x: np.ndarray, at: int, rate_hz: float, frequencies: list[float], size: int, hop: int, windows: range) -> np.ndarray:
    """x, whose first sample has the index `at`, without the weighted mean of what its windows hold of the sinusoids.

    A window begins at its number times the hop. Whole ones are solved together; what x holds of others one by one, if it
    is enough.
    """
    if not np.isfinite(x).all():
        raise ValueError("regression can't fill gaps")
    shape, noise, weight = np.hanning(size + 2)[1:-1], np.zeros(len(x)), np.zeros(len(x))
    starts = np.array(windows, np.int64) * hop - at
    whole = (starts >= 0) & (starts + size <= len(x))
    if whole.any():
        waves, solve = _solved(size, rate_hz, tuple(frequencies))
        views = np.lib.stride_tricks.sliding_window_view(x, size)
        for k in range(0, int(whole.sum()), TOGETHER):
            some = starts[whole][k : k + TOGETHER]
            parts = (views[some] @ solve.T) @ waves.T * shape
            for a, part in zip(some.tolist(), parts, strict=True):
                noise[a : a + size] += part
                weight[a : a + size] += shape
    for start in starts[~whole].tolist():
        a, b = max(start, 0), min(start + size, len(x))
        if b - a >= 2 * len(frequencies) + 2:
            w = shape[a - start : b - start]
            noise[a:b] += sinusoids(x[a:b], rate_hz, frequencies) * w
            weight[a:b] += w
    return x - np.divide(noise, weight, out=np.zeros_like(noise), where=weight > np.finfo(float).eps)


def regression(x: np.ndarray, rate_hz: float, s: Settings, offset: int = 0) -> np.ndarray:
    """x without the sinusoids of overlapping windows, which lie on whole multiples of the hop of the absolute index."""
    frequencies = regressed_frequencies(s, rate_hz)
    size, hop = window_shape(s, rate_hz)
    least = 2 * len(frequencies) + 2
    if size < least or len(x) < least:
        raise ValueError(f"regression needs {least} samples")
    return without_sinusoids(x, offset, rate_hz, frequencies, size, hop, range(max(0, -(-(offset - size + 1) // hop)), -(-(offset + len(x)) // hop)))


def prepare(x: np.ndarray, rate_hz: float, s: Settings | None, offset: int = 0) -> np.ndarray:
    """Gaps, then the band-pass, then notches or the regression. Regression refuses values that aren't finite."""
    if s is not None and s.show_filtered and s.method == "regression" and not np.isfinite(x).all():
        raise ValueError("regression can't fill gaps")
    y = fill_gaps(x)
    if s is None or not s.show_filtered:
        return y
    validate(s, rate_hz)
    if s.bandpass:
        y = bandpass(y, rate_hz, s.low_hz, s.high_hz)
    if s.method == "notch":
        for f in s.frequencies:
            y = notch(y, rate_hz, f, s.quality)
    elif s.method == "regression":
        y = regression(y, rate_hz, s, offset)
    return y


def segment_power(x: np.ndarray, rate_hz: float, hann: bool = True) -> np.ndarray:
    """One-sided power density of a segment, or of each row's, without its mean."""
    n = x.shape[-1]
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n) if hann else np.ones(n)
    p = np.abs(np.fft.rfft((x - x.mean(-1, keepdims=True)) * w)) ** 2 / (rate_hz * (w**2).sum())
    p[..., 1 : -1 if n % 2 == 0 else None] *= 2
    return p


def candidate_masks(x: np.ndarray, high: float, low: float) -> tuple[np.ndarray, np.ndarray]:
    """Inner points of finite triples not under (over) their neighbours and at or over (under) the threshold."""
    up, down = np.zeros(len(x), bool), np.zeros(len(x), bool)
    if len(x) >= 3:
        a, v, b = x[:-2], x[1:-1], x[2:]
        good = np.isfinite(a) & np.isfinite(v) & np.isfinite(b)
        with np.errstate(invalid="ignore"):
            up[1:-1] = good & (v >= a) & (v >= b) & (v >= high)
            down[1:-1] = good & (v <= a) & (v <= b) & (v <= low)
    return up, down


def plateau_middles(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Middles (rounded down) of runs of candidates that rise above what is beside them; runs at an end don't count."""
    at = np.flatnonzero(mask)
    if not len(at):
        return at
    cut = np.flatnonzero(np.diff(at) > 1)
    left, right = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]
    inner = (left > 0) & (right < len(x) - 1)
    left, right = left[inner], right[inner]
    good = (x[left] > x[left - 1]) & (x[right] > x[right + 1])
    return (left[good] + right[good]) // 2


def keep_distant(at: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """Highest first, a peak takes out all within less than the distance; the later of two equals goes first."""
    keep = np.ones(len(at), bool)
    for k in np.argsort(height, kind="stable")[::-1]:
        if keep[k]:
            a, b = np.searchsorted(at, at[k] - distance, "right"), np.searchsorted(at, at[k] + distance, "left")
            keep[a:b] = False
            keep[k] = True
    return keep


def prominence(x: np.ndarray, k: int, reach: int) -> float:
    """Height over the higher of the two lowest points between the peak and, on each side, higher ground or the reach."""
    base = []
    for side in (x[max(0, k - reach) : k][::-1], x[k + 1 : k + 1 + reach]):
        higher = np.flatnonzero(side > x[k])
        part = side[: higher[0]] if len(higher) else side
        base.append(min(x[k], part.min()) if len(part) else x[k])
    return float(x[k] - max(base))


def _powers(x: np.ndarray, pick: np.ufunc, reach: int) -> list[np.ndarray]:
    """`pick` over each run of 1, 2, 4, ... values up to the reach, by where the run begins."""
    out = [x]
    while 2 * (step := 1 << (len(out) - 1)) <= min(reach, len(x)):
        out.append(pick(out[-1][:-step], out[-1][step:]))
    return out


def prominences(x: np.ndarray, at: np.ndarray, reach: int) -> np.ndarray:
    """The same for many peaks at once, by runs of powers of two: no work of the reach for each; missing values are passed over."""
    missing = np.isnan(x)
    low, high = _powers(np.where(missing, np.inf, x), np.minimum, reach), _powers(np.where(missing, -np.inf, x), np.maximum, reach)
    top, bases = x[at], []
    for back in (True, False):
        base, place = np.full(len(at), np.inf), at if back else at + 1
        left = np.minimum(reach, at if back else len(x) - 1 - at)  # values that may still be passed
        for k in range(len(low) - 1, -1, -1):
            begin = place - (1 << k) if back else place
            some = np.flatnonzero(left >= 1 << k)
            some = some[high[k][begin[some]] <= top[some]]
            base[some] = np.minimum(base[some], low[k][begin[some]])
            place = place.copy()
            place[some] += -(1 << k) if back else 1 << k
            left = left.copy()
            left[some] -= 1 << k
        bases.append(np.minimum(base, top))
    return top - np.maximum(*bases)


def block_peaks(x: np.ndarray, mask: np.ndarray, height: float, least: float, distance: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices, prominences): plateaus, height, distance, then prominence."""
    at = plateau_middles(x, mask)
    at = at[x[at] >= height]
    if len(at) > 1:
        at = at[keep_distant(at, x[at], distance)]
    found = np.array([prominence(x, k, reach) for k in at])
    good = found >= least if len(at) else np.zeros(0, bool)
    return at[good], found[good]
