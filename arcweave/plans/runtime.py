"""Execution mode and what the last operation of a thread did."""

from __future__ import annotations

import threading
import time
from contextlib import contextmanager
from dataclasses import asdict, dataclass

_LOCAL = threading.local()
_MODE = "auto"


@dataclass
class RunInfo:
    op: str
    path: str
    iterations: int
    ms: float


def set_execution(mode: str) -> None:
    """How steps meet the edges. "auto": Spark chooses by the size of the vertices' table, and sends small ones to all
    tasks, so that edges need not be sorted. "distributed": always by exchange and sort-merge join, whatever the size."""
    global _MODE
    if mode not in ("auto", "distributed"):
        raise ValueError(f"unknown execution mode {mode!r}")
    _MODE = mode


def execution() -> str:
    return _MODE


def last_run_info() -> dict | None:
    """op, path, iterations and ms of this thread's last operation; None before the first."""
    info = getattr(_LOCAL, "info", None)
    return asdict(info) if info else None


@contextmanager
def recorded(op: str):
    """Gives a RunInfo to fill in; recorded when the operation returns."""
    info, began = RunInfo(op, _MODE, 0, 0.0), time.perf_counter()
    yield info
    info.ms = (time.perf_counter() - began) * 1e3
    _LOCAL.info = info
