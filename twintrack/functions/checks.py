"""Checks of options; each raises a ValueError that names the option."""

from __future__ import annotations

import math


def positive(**options: float) -> None:
    for name, v in options.items():
        if not (isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) and v > 0):
            raise ValueError(f"{name} must be positive, not {v!r}")


def least_zero(**options: float) -> None:
    for name, v in options.items():
        if not (isinstance(v, (int, float)) and not isinstance(v, bool) and v >= 0):
            raise ValueError(f"{name} must not be negative: {v!r}")


def share(**options: float) -> None:
    for name, v in options.items():
        if not (isinstance(v, (int, float)) and not isinstance(v, bool) and 0 <= v <= 1):
            raise ValueError(f"{name} must lie between 0 and 1, not {v!r}")


def whole(**options: int) -> None:
    """Whole numbers of at least 1."""
    for name, v in options.items():
        if isinstance(v, bool) or not isinstance(v, (int, float)) or v != int(v) or v < 1:
            raise ValueError(f"{name} must be a positive whole number, not {v!r}")


def one_of(name: str, v: str, known: tuple[str, ...]) -> None:
    if v not in known:
        raise ValueError(f"unknown {name} {v!r}; known are {', '.join(known)}")


def columns(there: list[str], wanted: list[str]) -> None:
    if lost := [c for c in wanted if c not in there]:
        raise ValueError(f"no such columns: {', '.join(lost[:10])}")
