"""Kernels against plain loops and full matrices: the filter as a scan, splines by three bands, gaps of long tracks."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twintrack.operators import kernels
from twintrack.params import Params


def loop(b, a, x, z1, z2):
    out = []
    for v in x:
        y = b[0] * v + z1
        z1, z2 = b[1] * v - a[1] * y + z2, b[2] * v - a[2] * y
        out.append(y)
    return np.array(out)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 500), st.floats(0.5, 39.0))
def test_filter_is_the_loop(seed, n, fc):
    r = np.random.default_rng(seed)
    b, a = kernels.butterworth(fc, 80.0)
    x, z = r.normal(size=(n, 3)) * 100, r.normal(size=(2, 3))
    got = kernels.recursive(b, a, x, z)
    want = np.column_stack([loop(b, a, x[:, k], *z[:, k]) for k in range(3)])
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)


def test_columns_are_filtered_as_if_alone():
    r = np.random.default_rng(1)
    x = np.cumsum(r.normal(size=(1000, 2)), 0)
    both = kernels.lowpass(x, 8, 80, 4)
    for k in range(2):
        np.testing.assert_allclose(both[:, k], kernels.lowpass(x[:, k], 8, 80, 4), rtol=1e-12)
    assert np.array_equal(both[:4], x[:4]) and np.array_equal(both[-4:], x[-4:])


@pytest.mark.parametrize("n", [4, 5, 9, 200])
def test_spline_solves_the_full_system(n):
    """Not-a-knot: a cubic comes back exactly, and third derivatives agree at the second and the last but one knot."""
    r = np.random.default_rng(n)
    t = np.cumsum(r.uniform(0.2, 2.0, n))
    q = np.linspace(t[0], t[-1], 77)
    cubic = lambda v: 0.3 * v**3 - v**2 + 4 * v - 1
    np.testing.assert_allclose(kernels.interpolated(t, cubic(t), q, "spline"), cubic(q), rtol=1e-8, atol=1e-8)
    below, middle, above, x = r.normal(size=n), r.uniform(4, 5, n), r.normal(size=n), r.normal(size=n)
    full = np.diag(middle) + np.diag(above[:-1], 1) + np.diag(below[1:], -1)
    np.testing.assert_allclose(kernels.three_bands(below, middle, above, x), np.linalg.solve(full, x), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("method", ["pchip", "makima", "spline"])
def test_gaps_of_a_long_track(method):
    n = 100_000
    t = np.arange(n) / 80.0
    x, y = np.sin(t) * 50 + t, np.cos(t / 2) * 40
    holes = np.arange(500, n - 500, 997)
    for k in range(3):
        x[holes + k] = np.nan
    gaps = Params.of({"gaps": {"method": method}}).gaps
    a, b, filled = kernels.fill_track(x, y, t, gaps, 5)
    assert filled.sum() == 3 * len(holes)
    np.testing.assert_allclose(a[filled], (np.sin(t) * 50 + t)[filled], atol=0.05)
    # a short track around one hole, filled from all its points, gives the same values
    s = slice(int(holes[3]) - 300, int(holes[3]) + 300)
    good = np.isfinite(x[s])
    whole = kernels.interpolated(t[s][good], x[s][good], t[s][~good], method)
    np.testing.assert_allclose(a[s][~good], whole, rtol=1e-12, atol=1e-12)
