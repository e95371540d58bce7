"""Parameters and statistics of a ranking run."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class PageRankParams:
    """tol is not validated: with tol <= 0 a run goes on to max_iters."""

    damping: float = 0.85
    tol: float = 1e-6
    max_iters: int = 100
    thread_max: int = 16
    warp_max: int = 256
    host_share: float = 0.5
    precision: str = "double"

    def __post_init__(self):
        if math.isnan(self.damping) or not 0 < self.damping < 1:
            raise ValueError(f"damping must be between 0 and 1, not {self.damping}")
        if self.max_iters < 1:
            raise ValueError("max_iters must be 1 at least")
        if not 0 <= self.host_share <= 1:
            raise ValueError("host_share must be from 0 to 1")
        if not 0 <= self.thread_max <= self.warp_max:
            raise ValueError("row classes need 0 <= thread_max <= warp_max")
        if self.precision not in ("double", "float"):
            raise ValueError("precision is double or float")


@dataclass(frozen=True)
class PageRankStats:
    iterations: int
    error: float
    seconds: float
    converged: bool
    host_rows: int = 0
    host_edges: int = 0
    host_min_len: int = 0
