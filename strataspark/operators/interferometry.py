"""Dispersion by phase-matched filters, three-station interferograms, and noise removal by transfer functions: kernels on batches of traces."""

from __future__ import annotations

import numpy as np


def frequency_times(x: np.ndarray, delta: float, distance: np.ndarray, periods: np.ndarray, alpha: float = 20.0, vmin: float = 1.5, vmax: float = 5.0) -> dict[str, np.ndarray]:
    """Group velocity, amplitude and signal-to-noise ratio (rows by periods) of the traces in the rows of x, in one transform for all.

    As signal.frequency_time does for one: Gaussian bands, the largest envelope between the fastest and the slowest wave,
    refined by a parabola; noise is the root mean square after it. NaN where a window is empty.
    """
    n = 1 << int(np.ceil(np.log2(2 * x.shape[1])))
    w, w0 = 2 * np.pi * np.fft.fftfreq(n, delta), 2 * np.pi / periods
    spectra = np.fft.fft(x - x.mean(axis=1, keepdims=True), n)
    out = {k: np.full((len(x), len(periods)), np.nan) for k in ("group", "amplitude", "snr")}
    time = np.arange(x.shape[1]) * delta
    inside = (time >= distance[:, None] / vmax) & (time <= distance[:, None] / vmin)
    after = time > distance[:, None] / vmin
    rows = np.arange(len(x))
    usable = inside.sum(axis=1) > 2
    for b, c in enumerate(w0):
        e = (alpha * np.sqrt(np.maximum(distance, 1.0) / 1000))[:, None] * ((w - c) / c) ** 2
        env = np.abs(np.fft.ifft(spectra * np.where((e < 40) & (w > 0), 2 * np.exp(-np.minimum(e, 40)), 0)))[:, : x.shape[1]]
        k = np.clip(np.where(inside, env, -1).argmax(axis=1), 1, x.shape[1] - 2)
        y0, y1, y2 = env[rows, k - 1], env[rows, k], env[rows, k + 1]
        bend = y0 - 2 * y1 + y2
        off = np.clip(np.where(bend < 0, 0.5 * (y0 - y2) / np.where(bend == 0, 1, bend), 0), -0.5, 0.5)
        noise = np.sqrt((np.where(after, env, 0) ** 2).sum(axis=1) / np.maximum(after.sum(axis=1), 1))
        for name, v in (("group", distance / np.maximum((k + off) * delta, 1e-12)), ("amplitude", y1), ("snr", y1 / np.maximum(noise, 1e-30))):
            out[name][usable, b] = v[usable]
    return out


def dispersed(n: int, delta: float, distance: float, periods: np.ndarray, group: np.ndarray, centre: float, width: float) -> np.ndarray:
    """A wave that travelled distance with a group velocity curve, with a spectrum of width around centre (angular frequencies)."""
    w = 2 * np.pi * np.fft.rfftfreq(n, delta)
    t = np.interp(w, 2 * np.pi / periods[::-1], distance / group[::-1])
    phase = np.concatenate([[0], np.cumsum(0.5 * (t[1:] + t[:-1]) * np.diff(w))])
    return np.fft.irfft(np.exp(-1j * phase) * np.exp(-(((w - centre) / width) ** 2)), n)


def phase_matched(x: np.ndarray, delta: float, distance: float, periods: np.ndarray, group: np.ndarray, width: float = 20.0) -> np.ndarray:
    """x with what doesn't follow the group velocity curve taken out.

    The phase that the curve predicts, the integral of the group time over frequency, is taken off, so that the wave
    becomes a pulse at time 0; that is cut out with a Gaussian of width seconds, and the phase is put back.
    """
    n = 1 << int(np.ceil(np.log2(4 * len(x))))
    w = 2 * np.pi * np.fft.rfftfreq(n, delta)
    at = 2 * np.pi / periods[::-1]
    t = np.interp(w, at, distance / group[::-1])
    phase = np.concatenate([[0], np.cumsum(0.5 * (t[1:] + t[:-1]) * np.diff(w))])
    pulse = np.fft.irfft(np.fft.rfft(x, n) * np.exp(1j * phase), n)
    # the curve gives the phase up to a constant: the envelope, not the wave, stands at time 0
    when = np.minimum(np.arange(n), n - np.arange(n)) * delta
    return np.fft.irfft(np.fft.rfft(pulse * np.exp(-((when / width) ** 2))) * np.exp(-1j * phase), n)[: len(x)]


def repaired(periods: np.ndarray, group: np.ndarray, most: float, longest: int) -> tuple[np.ndarray, slice]:
    """A group velocity curve whose jumps (over most between neighbours) that last longest points at most are replaced by a line, and its longest stretch without a jump."""
    g = group.copy()
    k = 1
    while k < len(g):
        if abs(g[k] - g[k - 1]) > most:
            back = next((j for j in range(k + 1, min(len(g), k + longest + 1)) if abs(g[j] - g[k - 1]) <= most * (j - k + 1)), None)
            if back is not None:
                g[k:back] = np.interp(periods[k:back], periods[[k - 1, back]], g[[k - 1, back]])
                k = back
        k += 1
    cuts = [0, *(np.flatnonzero(np.abs(np.diff(g)) > most) + 1), len(g)]
    a, b = max(zip(cuts, cuts[1:], strict=False), key=lambda s: (s[1] - s[0], -s[0]))
    return g, slice(int(a), int(b))


def phase_shifted(x: np.ndarray, delta: float, difference: np.ndarray, periods: np.ndarray, velocity: np.ndarray, turn: float) -> np.ndarray:
    """The rows of x moved back by difference / C(f) and by turn of phase, so that interferograms of all sources line up."""
    n = 1 << int(np.ceil(np.log2(2 * x.shape[1])))
    f = np.fft.rfftfreq(n, delta)
    c = np.interp(f, 1 / periods[::-1], velocity[::-1])
    return np.fft.irfft(np.fft.rfft(x, n) * np.exp(2j * np.pi * f * difference[:, None] / c + 1j * turn * (f > 0)), n)[:, : x.shape[1]]


def decimated(x: np.ndarray, factor: int, half: int = 8) -> np.ndarray:
    """Every factor-th sample of the rows of x after a low pass without delay: a windowed sinc of half * factor samples to each side, ends mirrored."""
    k = np.arange(-half * factor, half * factor + 1)
    h = np.sinc(k / factor) * (0.54 + 0.46 * np.cos(np.pi * k / (half * factor)))
    h /= h.sum()
    p = np.pad(x, ((0, 0), (half * factor, half * factor)), "reflect")
    return np.lib.stride_tricks.sliding_window_view(p, len(h), axis=1)[:, ::factor] @ h


def noise_removed(z: np.ndarray, others: list[np.ndarray], window: int) -> np.ndarray:
    """z (windows of days in rows, each of window samples) without what transfer functions predict from others, one after the other.

    A transfer function is the cross spectrum over the power, both summed over all windows of the station and month; each
    step also takes the first's part out of those that follow, so that they count only for what is new in them.
    """
    left, rest = np.fft.rfft(z, window), [np.fft.rfft(o, window) for o in others]
    while rest:
        h = rest.pop(0)
        power = np.maximum((np.abs(h) ** 2).sum(axis=0), 1e-300)
        take = lambda x, h=h, power=power: x - (x * np.conj(h)).sum(axis=0) / power * h
        left, rest = take(left), [take(r) for r in rest]
    return np.fft.irfft(left, window)
