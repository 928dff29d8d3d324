"""Opaque page cursors and page bounds."""

from __future__ import annotations

import base64
import json

DEFAULT_LIMIT, MAX_LIMIT, TIMELINE_MAX = 50, 100, 200
MAX_BYTES, MAX_SCOPE, MAX_TIE = 512, 64, 191
#: Number of components of a timeline cursor's tie-breaker, by rank: event, activity, attempt, progress, approval.
RANK_PARTS = (1, 1, 2, 3, 1)


class CursorError(ValueError):
    pass


def bounded_limit(limit: int | None, most: int = MAX_LIMIT) -> int:
    limit = DEFAULT_LIMIT if limit is None else limit
    if not 0 < limit <= most:
        raise ValueError(f"limit must be between 1 and {most}")
    return limit


def _check(scope: str, tie: str) -> None:
    if not (0 < len(scope) <= MAX_SCOPE and scope.isascii()):
        raise CursorError("invalid scope")
    if not 0 < len(tie.encode()) <= MAX_TIE:
        raise CursorError("invalid tie breaker")


def encode(scope: str, timestamp: int, tie_breaker: str) -> str:
    _check(scope, tie_breaker)
    text = json.dumps({"version": 1, "scope": scope, "timestamp": timestamp, "tie_breaker": tie_breaker}, separators=(",", ":"))
    out = base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")
    if len(out) > MAX_BYTES:
        raise CursorError("cursor too long")
    return out


def decode(cursor: str, scope: str) -> tuple[int, str]:
    if len(cursor) > MAX_BYTES or "=" in cursor:
        raise CursorError("invalid cursor")
    try:
        got = json.loads(base64.b64decode(cursor + "=" * (-len(cursor) % 4), altchars=b"-_", validate=True))
    except ValueError as e:
        raise CursorError("invalid cursor") from e
    if not isinstance(got, dict) or set(got) != {"version", "scope", "timestamp", "tie_breaker"} or got["version"] != 1 or got["scope"] != scope:
        raise CursorError("invalid cursor")
    if not isinstance(got["timestamp"], int) or not isinstance(got["tie_breaker"], str):
        raise CursorError("invalid cursor")
    _check(scope, got["tie_breaker"])
    return got["timestamp"], got["tie_breaker"]


def decode_number(cursor: str, scope: str) -> tuple[int, int]:
    """(timestamp, id) of a page over (time, id)."""
    at, tie = decode(cursor, scope)
    if not tie.isascii() or not tie.isdigit() or int(tie) <= 0:
        raise CursorError("invalid cursor")
    return at, int(tie)


def decode_timeline(cursor: str, scope: str) -> tuple[int, int, tuple[int, ...]]:
    """(timestamp, rank, components)."""
    at, tie = decode(cursor, scope)
    rank, *parts = tie.split(":")
    if not rank.isdigit() or int(rank) >= len(RANK_PARTS) or len(parts) != RANK_PARTS[int(rank)] or not all(p.isascii() and p.isdigit() and len(p) == 20 for p in parts):
        raise CursorError("invalid cursor")
    return at, int(rank), tuple(map(int, parts))
