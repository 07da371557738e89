"""Settings by precedence (told, environment, session, default) and sizes of worker pools."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping
from typing import Any

PREFIX = "LINELEAF_"


def first_valid(candidates: Iterable[Any], read, valid) -> Any:
    """The first candidate that reads and is valid, else None."""
    for value in candidates:
        try:
            found = read(str(value).strip())
        except ValueError:
            continue
        if value is not None and valid(found):
            return found
    return None


def ocr_dpi(conf: Mapping[str, Any], default: int = 200, env: Mapping[str, str] = os.environ) -> int:
    return first_valid([env.get(PREFIX + "OCR_DPI"), conf.get("ocr_dpi")], int, lambda v: v > 0) or default


def confidence_gate(conf: Mapping[str, Any], default: float = 0.7, env: Mapping[str, str] = os.environ) -> float:
    """At most 1; the default where the first value that reads isn't positive."""
    gate = first_valid([env.get(PREFIX + "CONFIDENCE_GATE"), conf.get("confidence_gate")], float, lambda v: v == v)
    return default if gate is None or gate <= 0 else min(gate, 1.0)


def complement_engine(told: str | None, engines: list[str], preferred: str = "surya", env: Mapping[str, str] = os.environ) -> str:
    """The engine that re-reads doubtful lines: as told, as the environment says, the preferred one, the first, or none."""
    known = first_valid([told, env.get(PREFIX + "COMPLEMENT")], str.lower, lambda v: v in (*engines, "none"))
    return known or (preferred if preferred in engines else next(iter(engines), "none"))


def page_workers(cpus: int, free_gb: float | None, worker_gb: float = 1.5, headroom: float = 0.9) -> int:
    """Half the cores but one, as many as fit into the free memory, at least one."""
    fits = cpus if free_gb is None else int(headroom * free_gb / worker_gb)
    return max(min(max(cpus // 2 - 1, 1), max(fits, 1)), 1)


def model_slots(memory_mb: int | None, share: float, model_mb: int = 1700, slot_mb: int = 1500, most: int = 8) -> int:
    """How many requests a model may serve at once within its share of the memory, at least one."""
    return max(1, min(most, (int((memory_mb or 0) * share) - model_mb) // slot_mb))
