"""Numpy kernels on one track: what windows can't say (a fixpoint, a recursive filter, cubic interpolation). Missing is NaN."""

from __future__ import annotations

import math

import numpy as np


#: Points on either side of a gap that its curve is drawn through. A farther one counts for less than 2^-REACH.
REACH = 80


def widen(mask: np.ndarray, half: int) -> np.ndarray:
    out = mask.copy()
    for k in range(1, half + 1):
        out[k:] |= mask[:-k]
        out[:-k] |= mask[k:]
    return out


def hazen(values: np.ndarray, p: float) -> float:
    v = np.sort(values)
    h = min(max(v.size * p + 0.5, 1.0), v.size)
    low = v[int(math.floor(h)) - 1]
    return float(low + (h - math.floor(h)) * (v[int(math.ceil(h)) - 1] - low))


def interpolated(t: np.ndarray, v: np.ndarray, at: np.ndarray, method: str) -> np.ndarray:
    """Values at times ``at``; NaN outside the hull. Methods: linear, nearest (later at the middle), pchip, makima, spline."""
    out = np.full(at.size, np.nan)
    inside = (at >= t[0]) & (at <= t[-1])
    q = at[inside]
    if method == "linear" or t.size < 3 and method != "nearest":
        out[inside] = np.interp(q, t, v)
        return out
    k = np.clip(np.searchsorted(t, q, "right") - 1, 0, t.size - 2)
    if method == "nearest":
        out[inside] = np.where(q - t[k] >= t[k + 1] - q, v[k + 1], v[k])
        return out
    h, d = np.diff(t), np.diff(v) / np.diff(t)
    slope = {"pchip": _pchip, "makima": _makima, "spline": _spline}[method](h, d)
    s, w = q - t[k], h[k]
    c = (3 * d[k] - 2 * slope[k] - slope[k + 1]) / w
    e = (slope[k] + slope[k + 1] - 2 * d[k]) / w**2
    out[inside] = v[k] + s * (slope[k] + s * (c + s * e))
    return out


def _pchip(h: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Shape-preserving slopes: weighted harmonic means, one-sided three-point ends."""
    m = np.zeros(h.size + 1)
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    same = d[:-1] * d[1:] > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        m[1:-1] = np.where(same, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]), 0.0)

    def end(h0, h1, d0, d1):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if s * d0 <= 0:
            return 0.0
        return 3 * d0 if d0 * d1 <= 0 and abs(s) > 3 * abs(d0) else s

    m[0], m[-1] = end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])
    return m


def _makima(h: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Modified Akima slopes: neighbours weighed by how little the slope changes on the other side."""
    left, right = 2 * d[0] - d[1], 2 * d[-1] - d[-2]
    d = np.concatenate([[2 * left - d[0], left], d, [right, 2 * right - d[-1]]])
    w = np.abs(np.diff(d)) + np.abs(d[1:] + d[:-1]) / 2
    a, b = w[2:], w[:-2]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(a + b > 0, (a * d[1:-2] + b * d[2:-1]) / (a + b), 0.0)


def _spline(h: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Not-a-knot cubic spline slopes."""
    n = h.size + 1
    if n == 3:
        # a parabola through three points
        c = (d[1] - d[0]) / (h[0] + h[1])
        return np.array([d[0] - c * h[0], d[0] + c * h[0], d[1] + c * h[1]])
    below, middle, above, r = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    below[1:-1], middle[1:-1], above[1:-1] = h[1:], 2 * (h[:-1] + h[1:]), h[:-1]
    r[1:-1] = 3 * (h[1:] * d[:-1] + h[:-1] * d[1:])
    middle[0], above[0] = h[1], h[0] + h[1]
    r[0] = ((h[0] + 2 * (h[0] + h[1])) * h[1] * d[0] + h[0] ** 2 * d[1]) / (h[0] + h[1])
    below[-1], middle[-1] = h[-1] + h[-2], h[-2]
    r[-1] = (h[-1] ** 2 * d[-2] + (2 * (h[-1] + h[-2]) + h[-1]) * h[-2] * d[-1]) / (h[-1] + h[-2])
    return three_bands(below, middle, above, r)


def three_bands(below: np.ndarray, middle: np.ndarray, above: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Solution of a system with three diagonals, in place of a full matrix."""
    lo, mid, up, x = below.tolist(), middle.tolist(), above.tolist(), r.tolist()
    for i in range(1, len(x)):
        f = lo[i] / mid[i - 1]
        mid[i] -= f * up[i - 1]
        x[i] -= f * x[i - 1]
    x[-1] /= mid[-1]
    for i in range(len(x) - 2, -1, -1):
        x[i] = (x[i] - up[i] * x[i + 1]) / mid[i]
    return np.array(x)


def jump_mask(x: np.ndarray, y: np.ndarray, t: np.ndarray, valid: np.ndarray, jump, limit: float) -> np.ndarray:
    """Frames that the iterative filter flags: repeat until no displacement exceeds the cutoff or ``max_iter`` is reached."""
    flagged = np.zeros(x.size, bool)
    if ((np.isfinite(x) & np.isfinite(y)) & valid).sum() < jump.min_valid_points:
        return flagged
    moved = np.hypot(np.diff(x), np.diff(y))
    moved = moved[np.isfinite(moved)]
    if not moved.size:
        return flagged
    cutoff = min(hazen(moved, jump.diff_quantile), limit)
    x, y = x.copy(), y.copy()
    for _ in range(jump.max_iter):
        here = np.isfinite(x) & np.isfinite(y)
        with np.errstate(invalid="ignore"):
            bad = np.append(False, np.hypot(np.diff(x), np.diff(y)) > cutoff) & valid & here
        if not bad.any():
            break
        bad = widen(bad, jump.dilate_frames) & valid
        good = here & valid & ~bad
        if good.sum() < 2:
            break
        x[bad] = interpolated(t[good], x[good], t[bad], jump.method)
        y[bad] = interpolated(t[good], y[good], t[bad], jump.method)
        flagged |= bad
    return flagged


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """[start, stop) of the runs of a mask."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def fill_track(x: np.ndarray, y: np.ndarray, t: np.ndarray, gaps, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Short gaps filled one after the other, each from all frames that are there by then."""
    x, y, filled = x.copy(), y.copy(), np.zeros(x.size, bool)
    for s, e in runs(~(np.isfinite(x) & np.isfinite(y))):
        at_end = s == 0 or e == x.size
        if e - s > limit or at_end and not gaps.fill_ends:
            continue
        good = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
        if good.size < gaps.min_points_for_interp:
            continue
        k = int(np.searchsorted(good, s))
        good = good[max(0, k - REACH) : k + REACH]
        x[s:e] = interpolated(t[good], x[good], t[s:e], gaps.method)
        y[s:e] = interpolated(t[good], y[good], t[s:e], gaps.method)
        filled[s:e] = np.isfinite(x[s:e]) & np.isfinite(y[s:e])
    return x, y, filled


def butterworth(fc: float, fps: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (b, a) of the second-order low-pass at ``fc``."""
    k = math.tan(math.pi * fc / fps)
    n = 1 / (1 + math.sqrt(2) * k + k * k)
    return np.array([k * k, 2 * k * k, k * k]) * n, np.array([1.0, 2 * (k * k - 1) * n, (1 - math.sqrt(2) * k + k * k) * n])


def recursive(b: np.ndarray, a: np.ndarray, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Second-order recursive filter of the columns of ``x`` (n, k) from the states ``z`` (2, k), as a scan over blocks.

    The state moves by a 2x2 matrix and the input, so blocks of about sqrt(n) samples are filtered side by side from rest, the
    states at their borders follow from the matrix to the power of a block's length, and what a block's first state adds to each
    sample is a row of a lower power: 2 sqrt(n) steps in place of n.
    """
    n, k = x.shape
    size = max(1, math.isqrt(n))
    blocks = -(-n // size)
    v = np.zeros((blocks * size, k))
    v[:n] = x
    v = v.reshape(blocks, size, k)
    step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    enter = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    out, rest = np.empty_like(v), np.zeros((2, blocks, k))
    seen, power = np.empty((size, 2)), np.eye(2)
    for t in range(size):
        out[:, t] = b[0] * v[:, t] + rest[0]
        rest = np.einsum("ij,jbk->ibk", step, rest) + enter[:, None, None] * v[:, t]
        seen[t] = power[0]
        power = step @ power
    starts = np.empty((blocks, 2, k))
    for j in range(blocks):
        starts[j] = z
        z = power @ z + rest[:, j]
    return (out + np.einsum("ti,bik->btk", seen, starts)).reshape(-1, k)[:n]


def zero_phase(x: np.ndarray, fc: float, fps: float) -> np.ndarray:
    """Forward and backward, over an odd reflection of six samples at either end, from the steady state. One or more columns."""
    b, a = butterworth(fc, fps)
    pad = 6
    c = x.reshape(len(x), -1)
    ext = np.concatenate([2 * c[0] - c[pad:0:-1], c, 2 * c[-1] - c[-2 : -pad - 2 : -1]])
    # state in which a constant input stays as it is
    z2 = b[2] - a[2]
    still = np.array([[b[1] - a[1] + z2], [z2]])
    forth = recursive(b, a, ext, still * ext[0])
    back = forth[::-1]
    return recursive(b, a, back, still * back[0])[::-1][pad:-pad].reshape(x.shape)


def lowpass(x: np.ndarray, fc: float, fps: float, n_pad: int) -> np.ndarray:
    """Zero-phase filter of one segment, of one or more columns; its outer ``n_pad`` samples stay. Segments that can't be filtered stay."""
    if len(x) <= 6 or fc >= fps / 2:
        return x
    y = zero_phase(x, fc, fps)
    n = min(n_pad, len(x))
    if n:
        y[:n], y[-n:] = x[:n], x[-n:]
    return y


def smooth_track(x: np.ndarray, y: np.ndarray, repaired: np.ndarray, smooth, fc: float, fps: float) -> tuple[np.ndarray, np.ndarray]:
    gap = ~(np.isfinite(x) & np.isfinite(y))
    if smooth.break_at_repaired_points:
        gap |= widen(repaired, smooth.repair_break_halfwidth)
    xy = np.column_stack([x, y])
    for s, e in runs(~gap):
        if e - s >= smooth.min_segment_length:
            xy[s:e] = lowpass(xy[s:e], fc, fps, smooth.n_pad)
    return xy[:, 0].copy(), xy[:, 1].copy()
