"""Measures of one series in arrays, for Arrow groups: what the operators of `series`, `fitting` and `vetting` give for it, bit by bit but for sums.

Each is the near side of an operator on whole tables, which longer series still take. Nulls are NaN in points and None in results; points without a
time or a value are left out before.
"""

from __future__ import annotations

import numpy as np

MAD = 1.4826


def placed_median(x: np.ndarray) -> float:
    """The median of sorted values."""
    n = len(x)
    return float(x[n // 2] if n % 2 else (x[n // 2 - 1] + x[n // 2]) / 2)


def median(x: np.ndarray) -> float | None:
    """NaN doesn't count."""
    x = x[~np.isnan(x)]
    return partial_median(x) if len(x) else None


def sigma(x: np.ndarray, centre: float | None) -> float | None:
    """1.4826 times the median deviation from the centre."""
    deviation = None if centre is None else median(np.abs(x - centre))
    return None if deviation is None else deviation * MAD


def partial_median(x: np.ndarray) -> float:
    """The median of values in any order."""
    n = len(x)
    return placed_median(np.partition(x, n // 2 if n % 2 else (n // 2 - 1, n // 2)))


def ratio(a: float | None, b: float | None) -> float | None:
    return None if a is None or b is None or b == 0 else a / b


def times(a: float | None, b: float) -> float | None:
    return None if a is None else a * b


def most(*x: float | None) -> float | None:
    """The greatest that isn't None."""
    return max((v for v in x if v is not None), default=None)


def phase_days(time: np.ndarray, period: float, t0: float) -> np.ndarray:
    """Days from the nearest event, in [-P/2, P/2)."""
    x = time - t0 + period / 2
    return x - np.floor(x / period) * period - period / 2


def window(phase: np.ndarray, period: float, duration: float, width: float) -> np.ndarray:
    return (np.abs(phase) < duration * (0.5 * width)) & bool(period > 0 and duration > 0)


def running_median(x: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """The median of the n values about each place of `own`, NaN left out; NaN where there are under a fifth of them, three at least."""
    out = np.full(len(own), np.nan)
    if n:
        wide = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n // 2, np.nan), x, np.full(n // 2, np.nan)]), n)
        step = max(1, (1 << 20) // n)
        for i in range(0, len(own), step):
            part = wide[own[i : i + step]]
            some = np.isfinite(part).sum(1)
            enough = np.flatnonzero(some >= max(3, n // 5))
            part = np.sort(part[enough], axis=1)  # what isn't there comes last
            k, at = some[enough], np.arange(len(enough))
            out[i + enough] = (part[at, (k - 1) // 2] + part[at, k // 2]) / 2
    return out


def filled(by: np.ndarray, v: np.ndarray) -> np.ndarray:
    """v with NaN drawn on a line in `by` (ascending) between neighbours, and by the nearest at the ends."""
    known = np.flatnonzero(~np.isnan(v))
    gaps = np.flatnonzero(np.isnan(v))
    if not len(known) or not len(gaps):
        return v
    out, x, y, at = v.copy(), by[known], v[known], by[gaps]
    a, b = np.searchsorted(x, at, "right") - 1, np.searchsorted(x, at, "left")
    first, last = a < 0, b >= len(x)
    a, b = np.maximum(a, 0), np.minimum(b, len(x) - 1)
    span = np.where(x[b] == x[a], 1.0, x[b] - x[a])
    line = np.where(x[b] == x[a], y[a], y[a] + (y[b] - y[a]) * (at - x[a]) / span)
    out[gaps] = np.where(first, y[b], np.where(last, y[a], line))
    return out


def trend(time: np.ndarray, value: np.ndarray, days: float) -> np.ndarray:
    """`series.rolling_trend` of points in order of time."""
    n, whole = len(time), median(value)
    whole = np.nan if whole is None else whole
    step = median(np.diff(time)) if n > 1 else None
    raw = max(5, int(np.rint(days / step))) if step is not None and step > 0 else 5
    if n < 5:
        return np.full(n, whole)
    x = np.where(np.isfinite(value), value, np.nan)
    got = filled(np.arange(n, dtype=float), running_median(x, np.arange(n), raw + (raw + 1) % 2))
    return np.where(np.isnan(got), whole, got)


def detrended(time: np.ndarray, value: np.ndarray, days: float, masked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(trend, value over it by their median): `series.detrend` of points in order of time."""
    if masked is None:
        t = trend(time, value, days)
    else:
        t = np.full(len(time), np.nan)
        t[~masked] = trend(time[~masked], value[~masked], days)
        t = filled(time, t)
    with np.errstate(all="ignore"):
        x = value / t
    middle = median(x)
    return t, x / (np.nan if middle is None else middle)


def depth_snr(phase: np.ndarray, x: np.ndarray, period: float, duration: float) -> tuple[int, float | None, float | None, float | None]:
    """(n_in, depth, snr, local_snr)."""
    inside, near = window(phase, period, duration, 1.0), window(phase, period, duration, 5.0)
    near &= ~inside
    n_in = int(inside.sum())
    if n_in < 3 or len(x) - n_in < 20:
        return n_in, None, None, None
    out, around = x[~inside], x[near]
    base = median(out)
    depth = base - median(x[inside])
    noise = sigma(out, base)
    local = sigma(around, median(around)) if len(around) >= 20 else noise
    root = float(np.sqrt(n_in))
    return n_in, depth, times(ratio(depth, noise), root), times(ratio(depth, local), root)


def transits(time: np.ndarray, phase: np.ndarray, period: float, t0: float, duration: float) -> tuple[int, int]:
    """(n_transits, n_full): events with a point inside, and with three."""
    inside = window(phase, period, duration, 1.0)
    _, n = np.unique(np.floor((time[inside] - t0) / period + 0.5), return_counts=True)
    return len(n), int((n >= 3).sum())


def contrasts(x: np.ndarray, inside: np.ndarray, outside: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(rows, n_in, m_in, m_out, noise) of the rows of two masks over ascending values (NaN last) that take three values inside and `least` outside: medians, and 1.4826 times the median deviation outside.

    What a mask takes is sorted, so that its median is a place.
    """
    n_in, n = np.count_nonzero(inside, axis=1), len(x) - int(np.count_nonzero(np.isnan(x)))
    enough = (n_in >= 3) & (np.count_nonzero(outside, axis=1) >= least)
    if n < len(x):
        x, inside, outside = x[:n], inside[:, :n], outside[:, :n]
        enough &= inside.any(1) & outside.any(1)
    rows = np.flatnonzero(enough)
    if len(rows) < len(enough):
        inside, outside = inside[rows], outside[rows]

    def middles(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count, at = np.count_nonzero(mask, axis=1), np.flatnonzero(mask)
        first, start = np.cumsum(count) - count, np.arange(len(mask)) * n
        return count, (x[at[first + (count - 1) // 2] - start] + x[at[first + count // 2] - start]) / 2

    if not len(rows):
        return rows, n_in[rows], *[np.zeros(0)] * 3
    _, m_in = middles(inside)
    count, m_out = middles(outside)
    away = np.where(outside, np.abs(x - m_out[:, None]), np.inf)
    away.sort(axis=1)
    own = np.arange(len(rows))
    return rows, n_in[rows], m_in, m_out, (away[own, (count - 1) // 2] + away[own, count // 2]) / 2 * MAD


def cells(time: np.ndarray, x: np.ndarray, period: float, t0: float, duration: float, share: float, periods: int, epochs: int) -> list[tuple]:
    """(cell, n_in, m_in, m_out, period, epoch, noise) of each cell of the grid that has enough points; x ascends."""
    out: list[tuple] = []
    block = max(1, min(epochs, (1 << 18) // max(1, len(x))))  # epochs at a time
    for step, first in ((a, b) for a in range(periods) for b in range(0, epochs, block)):
        p = period * (1 - share + 2 * share * step / max(periods - 1, 1))
        e = t0 - 0.5 * duration + duration * np.arange(first, min(first + block, epochs))[:, None] / max(epochs - 1, 1)
        if not (p > 0 and duration > 0):
            continue  # no point is inside
        at = time - e + p / 2
        turns = at / p
        np.floor(turns, out=turns)
        turns *= p
        at -= turns
        at -= p / 2
        np.abs(at, out=at)
        rows, *facts = contrasts(x, at < duration * 0.5, ~(at < duration * 2.5), 20)
        out += [(step * epochs + first + j, n, a, b, float(p), float(e[j, 0]), noise) for j, n, a, b, noise in zip(rows.tolist(), *(f.tolist() for f in facts))]
    return out


def ephemeris(time: np.ndarray, x: np.ndarray, period: float, t0: float, duration: float, share: float, periods: int, epochs: int) -> tuple[float, float]:
    """`fitting.refine_ephemeris`: the period and epoch of the strongest cell, the first of equal ones."""
    order = np.argsort(x, kind="stable")
    rows = [(round((r[3] - r[2]) / r[6] * float(np.sqrt(r[1])), 9), -r[0], r[4], r[5]) for r in cells(time[order], x[order], period, t0, duration, share, periods, epochs) if r[6] != 0]
    best = max(rows, default=None)
    return (period, t0) if best is None else best[2:]


def by_group(group: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(groups, how many values each has, their medians)."""
    order = np.lexsort((x, group))
    g, v = group[order], x[order]
    cuts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    n = np.diff(np.r_[cuts, len(g)])
    return g[cuts], n, (v[cuts + (n - 1) // 2] + v[cuts + n // 2]) / 2 if len(g) else np.zeros(0)


def profile_duration(phase: np.ndarray, x: np.ndarray, period: float, duration: float, bins: int = 241) -> float:
    """`fitting.profile_duration`: the width of the folded medians under half depth, or the duration given."""
    place = np.clip(np.floor((phase / period + 0.5) * bins), 0, bins - 1)
    where, n, m = by_group(place, x)
    m = np.where(n >= 3, m, np.nan)
    at, every = ((where + 0.5) / bins - 0.5) * period, ((np.arange(bins) + 0.5) / bins - 0.5) * period
    far = max(1.5 * duration, 0.05 * period)
    out = np.abs(at) > (far if (np.abs(every) > far).sum() >= 5 else duration)
    centre = np.abs(at) < max(0.5 * duration, 2 * period / bins)
    have = ~np.isnan(m)
    if n.sum() < 50 or have.sum() < 20:
        return duration
    base, low = median(m[out]), median(m[centre])
    base = median(m) if base is None else base
    low = float(m[have].min()) if low is None else low
    below = at[have & (m < base - 0.5 * (base - low))]
    if base > low and len(below) >= 2 and 0 < below.max() - below.min() <= 0.5 * period:
        return float(below.max() - below.min())
    return duration


def events(time: np.ndarray, phase: np.ndarray, x: np.ndarray, period: float, t0: float, duration: float) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(how many there are, and of those with enough points number, depth, err): `series.event_depths` within five durations."""
    near = window(phase, period, duration, 5.0)
    inside = window(phase, period, duration, 1.0)[near]
    number, v = np.floor((time[near] - t0) / period + 0.5), x[near]
    good = []
    numbers = np.unique(number)
    for k in numbers:
        own = number == k
        y, z = v[own & inside], v[own & ~inside]
        if len(y) >= 3 and len(z) >= 6:
            base = median(z)
            good.append((k, base - median(y), sigma(z, base) / float(np.sqrt(len(y)))))
    a = np.array(good).reshape(-1, 3)
    return len(numbers), a[:, 0], a[:, 1], a[:, 2]


def odd_even(number: np.ndarray, depth: np.ndarray, err: np.ndarray) -> float:
    odd = number % 2 == 1
    if not odd.any() or odd.all():
        return 0.0
    mo, me = median(depth[odd]), median(depth[~odd])
    o = most(sigma(depth[odd], mo) / float(np.sqrt(odd.sum())), median(err[odd]))
    v = most(sigma(depth[~odd], me) / float(np.sqrt((~odd).sum())), median(err[~odd]))
    below = sigma(depth, median(depth)) if o is None or v is None else float(np.sqrt(o * o + v * v))
    return ratio(abs(mo - me), below) or 0.0


def phases(x: np.ndarray, c: np.ndarray, w: float) -> list[tuple]:
    """(phase, n_in, m_in, m_out, noise) of each phase of `series.secondary` with enough points; x ascends (NaN last), c is in cycles, w the width in cycles."""
    near, away = max(3 * w, 0.04), np.abs(c) > 2 * w
    out: list[tuple] = []
    block = max(1, (1 << 18) // max(1, len(x)))  # phases at a time
    for first in range(0, 141, block):
        phase = 0.15 + np.arange(first, min(first + block, 141)) * 0.005
        dist = c - phase[:, None] + 0.5
        dist = np.abs(dist - np.floor(dist) - 0.5)
        inside = dist < 0.5 * w
        rows, *facts = contrasts(x, inside, (dist < near) & ~inside & away, 10)
        out += zip(phase[rows].tolist(), *(f.tolist() for f in facts))
    return out


def secondary(phase: np.ndarray, x: np.ndarray, period: float, duration: float) -> tuple[float | None, float | None, float | None]:
    """(secondary_sigma, secondary_phase, secondary_depth)."""
    if len(x) < 50:
        return None, None, None
    order = np.argsort(x, kind="stable")
    rows = [(round((r[3] - r[2]) / r[4] * float(np.sqrt(r[1])), 9), -r[0], r[3] - r[2]) for r in phases(x[order], (phase / period)[order], duration / period) if r[4] != 0]
    best = max(rows, default=None)
    return (None, None, None) if best is None else (max(best[0], 0.0), -best[1], best[2])


def centroid_shift(time: np.ndarray, inside: np.ndarray, centroids: list[np.ndarray], days: float) -> tuple[float | None, float]:
    """(shift, sigma) of the centroids less their rolling medians, points in order of time."""
    d, z = [], []
    for x in centroids:
        x = x - trend(time, x, days)
        a, b = median(x[inside]), median(x[~inside])
        d.append(None if a is None or b is None else a - b)
        z.append(ratio(times(None if d[-1] is None else abs(d[-1]), float(np.sqrt(inside.sum()))), sigma(x[~inside], b)) or 0.0)
    return None if None in d else float(np.sqrt(d[0] ** 2 + d[1] ** 2)), float(np.sqrt(z[0] ** 2 + z[1] ** 2))


def red_noise(y: np.ndarray, lags: int = 20) -> float | None:
    """The median over lags of the absolute autocorrelation of values in order of time."""
    if not len(y):
        return None
    y = y - median(y)
    yy = float((y * y).sum())
    each = [ratio(float((y[k:] * y[:-k]).sum()), yy) for k in range(1, lags + 1) if len(y) > k]
    return median(np.abs([r for r in each if r is not None])) if each else None


def red_noise_beta(time: np.ndarray, x: np.ndarray, duration: float) -> float:
    """Spread of means of whole blocks over what white noise would give, of points in order of time."""
    n, dt = len(x), median(np.diff(time))
    if not (duration > 0 and dt is not None and dt > 0):
        return 1.0
    size = max(3, int(np.rint(duration / dt)))
    if n < 100 or size >= n // 5:
        return 1.0
    means = x[: n // size * size].reshape(-1, size).mean(1)
    beta = ratio(times(sigma(means, median(means)), float(np.sqrt(size))), sigma(x, median(x)))
    return 1.0 if beta is None else min(max(beta, 1.0), 5.0)


def mixed(x: np.ndarray) -> np.ndarray:
    """32-bit numbers (in 64), each made another of no visible order: shifts and odd factors, which lose nothing."""
    x = (x ^ x >> np.uint64(16)) * np.uint64(0x85EBCA6B) & np.uint64(0xFFFFFFFF)
    x = (x ^ x >> np.uint64(13)) * np.uint64(0xC2B2AE35) & np.uint64(0xFFFFFFFF)
    return x ^ x >> np.uint64(16)


def drawn(r: np.ndarray, n: int) -> np.ndarray:
    """Places 0 to n - 1, n for each replicate r, drawn with replacement by counters: alike on each run and in any order."""
    i = mixed(np.arange(n, dtype=np.uint64) & np.uint64(0xFFFFFFFF))
    return (mixed(i[None, :] + r[:, None].astype(np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def resampled(x: np.ndarray, replicates: int, cells: int = 1 << 20) -> np.ndarray:
    """The median of each replicate of x, drawn anew with replacement, `cells` draws at a time."""
    step, n, out = max(1, cells // max(1, len(x))), len(x), []
    for r in range(0, replicates, step):
        part = x[drawn(np.arange(r, min(r + step, replicates)), n)]
        part.partition(n // 2, axis=1)
        high = part[:, n // 2]
        out.append(high if n % 2 else (part[:, : n // 2].max(axis=1) + high) / 2)
    return np.concatenate(out)


def depth_error(y: np.ndarray, z: np.ndarray, replicates: int) -> float | None:
    """`vetting.residual_bootstrap` in ppm of values in and out of the windows, each in order of time."""
    if len(y) < 3 or len(z) < 20:
        return None
    spread = float(np.std(resampled(z, replicates) - resampled(y, replicates), ddof=1))
    noise = float(np.median(np.abs(z - np.median(z)))) * MAD
    err = spread if spread > 0 else noise / len(y) ** 0.5 if noise > 0 else None
    return None if err is None else err * 1e6


def tidied(time: np.ndarray, flux: np.ndarray, usable: np.ndarray, high: float, low: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(flux_norm, kept, high_outlier, low_outlier): `series.clean` of a series; usable are the points of good quality."""
    good = np.where(np.isfinite(flux) & (flux > 0), flux, np.nan)
    middle = median(good)
    x = good / (np.nan if middle is None else middle)
    kept = usable & ~np.isnan(time) & (x > 0)
    centre = median(x[kept])
    if centre is None:
        return x, kept, kept, kept
    spread = sigma(x[kept], centre)
    return x, kept, kept & (x > centre + high * spread), kept & (x < centre - low * spread)


def valid_flux(flux: np.ndarray, least: float = 0.5) -> bool:
    """`series.flux_validity` of a series."""
    good = flux[np.isfinite(flux) & (flux > 0)]
    if not len(good) or len(good) / len(flux) < least:
        return False
    centre = median(good)
    return centre > 0 and sigma(good, centre) > 0


def cleaning_facts(n_raw: int, x: np.ndarray, kept: np.ndarray, up: np.ndarray, down: np.ndarray) -> dict:
    """Of `series.quality_summary`, what cleaning leaves: nulls where it leaves nothing."""
    left = x[kept & ~up]
    some, final = bool(kept.any()), len(left) > 0
    centre = median(left)
    spread = sigma(left, centre)
    return {
        "n_kept": int(kept.sum()) if some else None, "n_high": int(up.sum()) if some else None, "n_low": int(down.sum()) if some else None,
        "n_final": len(left) if final else None, "rms_ppm": float(np.sqrt(np.mean((left - centre) ** 2))) * 1e6 if final else None, "noise_ppm": times(spread, 1e6),
    }


def gaps(time: np.ndarray) -> dict:
    """`series.gap_metrics` of a series."""
    t = np.sort(time[~np.isnan(time)])
    dt = np.diff(t)
    middle = median(dt)
    return {"baseline": float(t[-1] - t[0]) if len(t) else None, "median_dt_days": middle, "n_gaps": 0 if middle is None else int((dt > 5 * middle).sum()), "largest_gap": float(dt.max()) if len(dt) else None}
