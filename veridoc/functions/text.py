"""Pieces of SQL text: literals, names, let-bindings."""

from __future__ import annotations

import json
import threading
from typing import Any

_NAMES = threading.local()


def quote(s: str) -> str:
    """A SQL string literal."""
    out = s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\0", "\\0").replace("\x1a", "\\Z")
    return f"'{out}'"


def number(x: float) -> str:
    """A SQL double literal."""
    return f"CAST({quote(repr(float(x)))} AS DOUBLE)"


def fresh(prefix: str = "x") -> str:
    """A name that no other lambda uses."""
    number = getattr(_NAMES, "next", 0)
    _NAMES.next = number + 1
    return f"{prefix}{number}"


def restart() -> None:
    """This thread's names count from the start again, so one schema always gives the same text."""
    _NAMES.next = 0


def let(value: str, body) -> str:
    """body(name) with name bound to value, which is evaluated once."""
    name = fresh()
    return f"get(transform(array({value}), {name} -> {body(name)}), 0)"


def both(parts: list[str]) -> str:
    parts = [p for p in parts if p != "true"]
    if "false" in parts:
        return "false"
    return "(" + " AND ".join(parts) + ")" if parts else "true"


def either(parts: list[str]) -> str:
    parts = [p for p in parts if p != "false"]
    if "true" in parts:
        return "true"
    return "(" + " OR ".join(parts) + ")" if parts else "false"


def negate(part: str) -> str:
    return {"true": "false", "false": "true"}.get(part, f"(NOT {part})")


def spelled(value: Any) -> str:
    """A value as compact JSON, whole doubles as integers."""
    def plain(x: Any) -> Any:
        if isinstance(x, float) and x.is_integer() and abs(x) < 1e15:
            return int(x)
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value), ensure_ascii=False, separators=(",", ":"))
