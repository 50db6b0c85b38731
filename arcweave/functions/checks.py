"""Argument checks shared by the operators."""

from __future__ import annotations

import math

DIRECTIONS = ("out", "in", "both")
MAX_INDEX = 2**31 - 1


def check_direction(direction: str | int) -> str:
    if isinstance(direction, int) and not isinstance(direction, bool) and 0 <= direction < len(DIRECTIONS):
        return DIRECTIONS[direction]
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}, not {direction!r}")
    return direction


def check_rank_options(alpha: float, tol: float, max_iter: int) -> None:
    if not (math.isfinite(alpha) and 0 < alpha < 1):
        raise ValueError("alpha must lie between 0 and 1")
    if not (math.isfinite(tol) and tol > 0):
        raise ValueError("tol must be finite and above 0")
    if max_iter < 1:
        raise ValueError("max_iter must be at least 1")


def check_cap(name: str, value: int | None) -> int | None:
    """None and 0 are no cap."""
    if value is not None and value < 0:
        raise ValueError(f"{name} must not be negative")
    return value or None


def check_reserved(**filters) -> None:
    for name, value in filters.items():
        if value is not None:
            raise NotImplementedError(f"{name} is reserved for typed and temporal edges")
