"""Run options shared by the operators, with validation."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from typing import Any

# Option defaults and the longest single wait of the pacing rule.
DEFAULT_BUCKET_WIDTH = 6
DEFAULT_MAX_IO_BYTES = 1 << 20
MAX_WAIT_SECONDS = 3600.0
BUCKET_SECONDS = 600
PACE_MODES = ("fast", "real", "scaled")
FILTERABLE_SIDES = ("source", "target")


@dataclass(frozen=True)
class TraceOptions:
    """Options of a trace run.

    ``bucket_min``/``bucket_max`` form a closed range, ``bucket_max < 0`` leaves it open.
    ``side_filter`` keeps one side; any other word than ``source``/``target`` keeps all.
    ``max_events`` caps the events that pass the filters, 0 means no cap.

    Three options choose between the behaviour of the data as written and its intent:
    ``signed_numbers`` reads a leading minus sign (by default ``"-2"`` counts as 0),
    ``exit_closes`` lets ``exit_group`` drop every descriptor of the process, and
    ``ignore_corrupt_files`` skips unreadable files instead of failing.

    ``rows_per_slice`` is the target size of a time slice, the unit that keeps
    ordered operators parallel when one process or file dominates the trace.
    """

    events_root: str = ""
    sandbox_root: str = "/tmp/sandbox"
    bucket_width: int = DEFAULT_BUCKET_WIDTH
    bucket_min: int = 0
    bucket_max: int = -1
    pace_mode: str = "fast"
    speed: float = 1.0
    side_filter: str = "all"
    skip_unparsed: bool = True
    pid_filter: tuple[int, ...] = ()
    dry_run: bool = False
    max_io_bytes: int = DEFAULT_MAX_IO_BYTES
    continue_on_error: bool = True
    max_events: int = 0
    signed_numbers: bool = False
    exit_closes: bool = False
    ignore_corrupt_files: bool = False
    rows_per_slice: int = 1_000_000

    def __post_init__(self) -> None:
        object.__setattr__(self, "pid_filter", tuple(self.pid_filter))
        if not self.sandbox_root:
            raise ValueError("sandbox_root must not be empty")
        object.__setattr__(self, "sandbox_root", _absolute(self.sandbox_root))
        if self.pace_mode not in PACE_MODES:
            raise ValueError(f"pace_mode must be one of {PACE_MODES}, got {self.pace_mode!r}")
        if self.pace_mode == "scaled" and not self.speed > 0:
            raise ValueError("speed must be positive in scaled mode")
        if self.bucket_width < 1:
            raise ValueError("bucket_width must be >= 1")
        if self.max_events < 0:
            raise ValueError("max_events must be >= 0")
        if self.rows_per_slice < 1:
            raise ValueError("rows_per_slice must be >= 1")

    def with_(self, **changes: Any) -> TraceOptions:
        return replace(self, **changes)

    def require_source(self) -> str:
        if not self.events_root:
            raise ValueError("events_root must not be empty")
        return self.events_root

    @classmethod
    def from_mapping(cls, values: Mapping[str, Any]) -> TraceOptions:
        """Options from JSON-like values; a value of the wrong type falls back to its default."""
        chosen: dict[str, Any] = {}
        for f in fields(cls):
            value = values.get(f.name)
            kind = type(f.default)
            if f.name == "pid_filter":
                if isinstance(value, (list, tuple)):
                    chosen[f.name] = tuple(v for v in value if _is_int(v))
            elif kind is bool:
                if isinstance(value, bool):
                    chosen[f.name] = value
            elif kind is int:
                if _is_int(value):
                    chosen[f.name] = value
            elif kind is float:
                if _is_int(value) or isinstance(value, float):
                    chosen[f.name] = float(value)
            elif isinstance(value, str):
                chosen[f.name] = value
        if chosen.get("pace_mode", "fast") not in PACE_MODES:
            chosen["pace_mode"] = "fast"
        return cls(**chosen)

    @classmethod
    def from_json(cls, text: str) -> TraceOptions:
        try:
            values = json.loads(text)
        except json.JSONDecodeError as e:
            raise ValueError(f"options are not valid JSON: {e}") from e
        if not isinstance(values, dict):
            raise ValueError("options must be a JSON object")
        return cls.from_mapping(values)


def _is_int(value: Any) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


def _absolute(path: str) -> str:
    full = posixpath.abspath(path)
    return full[1:] if full.startswith("//") else full
