"""Index options and search settings, with the limits that each dialect of index declares."""

from __future__ import annotations

import re
from dataclasses import dataclass

from vecloom.functions.vectors import ALIASES


class OptionError(ValueError):
    """An option that is unknown, of the wrong type, or out of range."""


#: Limits by profile: least and most m, default and limits of ef_construction, whether it must be at least 2m. Fixed values.
PROFILES = {
    "columnar": {"m": (16, 2, 128), "ef_construction": (64, 1, 10_000), "twice_m": False},
    "row": {"m": (16, 2, 100), "ef_construction": (64, 4, 1_000), "twice_m": True},
    "embedded": {"m": (16, 2, 256), "ef_construction": (200, 1, 1 << 31), "twice_m": False},
}
KNOWN = {"m", "ef_construction", "metric", "parallel_workers", "threads", "quantizer", "pq_m", "memory_mode"}
#: Preferred dimensions of a sub-space, in this order. Fixed values.
SUB_DIMS = (4, 8, 3, 6, 2, 5, 1)


@dataclass(frozen=True)
class IndexOptions:
    m: int = 16
    ef_construction: int = 64
    metric: str = "l2"
    parallel_workers: int | None = None
    quantizer: str = "none"
    pq_m: int = 0
    memory_mode: str = "full"


@dataclass(frozen=True)
class SearchSettings:
    ef_search: int = 40
    brute_force_threshold: int = 10_000
    pq_search_mode: str = "off"
    pq_refine_k_factor: float = 1.0
    filtered_search: str = "exact"
    exact_check: bool = False

    def __post_init__(self):
        _range("ef_search", self.ef_search, 1, 65_535)
        _range("brute_force_threshold", self.brute_force_threshold, 0, 1_000_000)
        if self.pq_search_mode not in ("off", "pq_only"):
            raise OptionError(f"pq_search_mode must be off or pq_only, not {self.pq_search_mode!r}")
        if self.filtered_search not in ("exact", "graph"):
            raise OptionError(f"filtered_search must be exact or graph, not {self.filtered_search!r}")
        if not 1 <= self.pq_refine_k_factor <= 1000:
            raise OptionError("pq_refine_k_factor must be from 1 to 1000")

    def effective_ef(self, k: int) -> int:
        return 2 * k if k > self.ef_search else self.ef_search


def _range(name: str, value, least: int, most: int) -> int:
    if isinstance(value, str) and re.fullmatch(r"[+-]?\d+", value):
        value = int(value)
    if isinstance(value, bool) or not isinstance(value, int):
        raise OptionError(f"{name} must be an integer, not {value!r}")
    if not least <= value <= most:
        raise OptionError(f"{name} must be from {least} to {most}, not {value}")
    return value


def auto_pq_m(dims: int) -> int:
    return next(dims // d for d in SUB_DIMS if dims % d == 0)


def validate(dims: int, profile: str = "columnar", **options) -> IndexOptions:
    """Checked options with defaults filled in."""
    limits = PROFILES[profile]
    if unknown := set(options) - KNOWN:
        raise OptionError(f"unknown option {min(unknown)}")
    if not 1 <= dims <= 16_384:
        raise OptionError("vectors must have from 1 to 16384 dimensions")
    m = _range("m", options.get("m", limits["m"][0]), *limits["m"][1:])
    ef = _range("ef_construction", options.get("ef_construction", limits["ef_construction"][0]), *limits["ef_construction"][1:])
    if limits["twice_m"] and ef < 2 * m:
        raise OptionError("ef_construction must be at least 2 * m")
    metric = str(options.get("metric", "l2")).lower()
    metric = ALIASES.get(metric, metric)
    if metric not in ("l2", "cosine", "ip"):
        raise OptionError(f"unknown metric {metric!r}")
    workers = options.get("parallel_workers", options.get("threads"))
    if workers is not None:
        workers = _range("parallel_workers", workers, 1, 1024)
    quantizer = str(options.get("quantizer", "none")).lower()
    if quantizer not in ("none", "pq"):
        raise OptionError(f"quantizer {quantizer!r} is not supported")
    mode = str(options.get("memory_mode", "full")).lower()
    if mode not in ("full", "compact"):
        raise OptionError("memory_mode must be full or compact")
    pq_m = _range("pq_m", options.get("pq_m", 0), 0, dims)
    if mode == "compact":
        quantizer = "pq"
    if quantizer == "pq":
        pq_m = pq_m or auto_pq_m(dims)
        if dims % pq_m:
            raise OptionError(f"pq_m must divide {dims}")
    elif pq_m:
        raise OptionError("pq_m needs quantizer pq")
    return IndexOptions(m, ef, metric, workers, quantizer, pq_m, mode)
