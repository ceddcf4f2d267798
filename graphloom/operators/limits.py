"""Checks of a request's arguments, before a plan is built."""

from __future__ import annotations

from collections.abc import Sequence

# Fixed limits of the data model: bytes, items, hops, rows.
NAME_BYTES, BODY_BYTES, ITEMS, DEPTH = 1024, 65_536, 1000, 16
SEARCH_DEFAULT, SEARCH_MOST = 20, 1000
PATH_DEPTH, PATHS = 10, 100
DIMENSIONS, TOP_DEFAULT, TOP_MOST = 4096, 10, 100


def name(value: object) -> str:
    """A name: text that isn't empty, of at most 1,024 bytes."""
    if not isinstance(value, str) or not value:
        raise ValueError("a name must be a text that isn't empty")
    if len(value.encode("utf-8", "surrogatepass")) > NAME_BYTES:
        raise ValueError(f"a name has at most {NAME_BYTES} bytes")
    return value


def body(value: object) -> str:
    if not isinstance(value, str):
        raise ValueError("an observation must be a text")
    if len(value.encode("utf-8", "surrogatepass")) > BODY_BYTES:
        raise ValueError(f"an observation has at most {BODY_BYTES} bytes")
    return value


def occurred(value: int | None) -> int | None:
    """A time in microseconds, 0 or later; none if it isn't given."""
    if value is not None and (isinstance(value, bool) or not isinstance(value, int) or value < 0):
        raise ValueError("a time is a number of microseconds, 0 or later")
    return value


def items(values: Sequence) -> Sequence:
    if len(values) > ITEMS:
        raise ValueError(f"a request has at most {ITEMS} items")
    return values


def clamp(value: int | None, default: int, most: int, least: int = 1) -> int:
    """``value`` or the default, within the limits."""
    return min(max(default if value is None else value, least), most)


def search_limit(value: int | None = None) -> int:
    return clamp(value, SEARCH_DEFAULT, SEARCH_MOST)


def top_k(value: int | None = None) -> int:
    return clamp(value, TOP_DEFAULT, TOP_MOST)


def depth(value: int | None = None) -> int:
    return clamp(value, 1, DEPTH, 0)


def texts(value: object) -> list[str] | None:
    """A filter list: none if missing or empty; a member that is no text is an error."""
    if value is None:
        return None
    if not isinstance(value, list | tuple) or any(not isinstance(x, str) for x in value):
        raise ValueError("a filter is a list of texts")
    return list(value) or None


def vector(value: Sequence[float]) -> Sequence[float]:
    if not 0 < len(value) <= DIMENSIONS:
        raise ValueError(f"a vector has 1 to {DIMENSIONS} dimensions")
    return value
