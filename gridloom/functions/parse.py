"""Literals as users write them."""

from __future__ import annotations

import datetime as dt
import re

from ..errors import InvalidParameter
from .period import EPOCH, Period

#: Type codes and categories (fixed values).
TYPES = {
    "SingleTimeSeries": 0,
    "NonSequentialTimeSeries": 1,
    "Deterministic": 2,
    "DeterministicSingleTimeSeries": 3,
    "Probabilistic": 4,
    "Scenarios": 5,
}
CATEGORIES = ("Component", "SupplementalAttribute")
SINGLE, IRREGULAR, DETERMINISTIC, DERIVED, PROBABILISTIC, SCENARIOS = range(6)


def _plain(text: str) -> str:
    return text.replace("_", "").lower()


def series_type(text: str) -> int:
    for name, code in TYPES.items():
        if _plain(name) == _plain(text):
            return code
    raise InvalidParameter(f"unknown time series type: {text!r}")


def owner_category(text: str) -> str:
    for name in CATEGORIES:
        if _plain(name) == _plain(text):
            return name
    raise InvalidParameter(f"unknown owner category: {text!r}")


def period(text: str) -> Period:
    return Period.parse(text)


def timestamp(text: str, offset: str | None = None) -> dt.datetime:
    """RFC 3339, epoch milliseconds, or without a zone if a fixed offset is given; as UTC without a zone."""
    text = text.strip()
    if re.fullmatch(r"-?\d+", text):
        return EPOCH + dt.timedelta(milliseconds=int(text))
    try:
        t = dt.datetime.fromisoformat(text)
    except ValueError as e:
        raise InvalidParameter(f"not a timestamp: {text!r}") from e
    if t.tzinfo is None:
        if offset is None:
            raise InvalidParameter(f"{text!r} has no zone; state a fixed offset such as +00:00")
        m = re.fullmatch(r"Z|([+-])(\d\d):?(\d\d)", offset)
        if not m:
            raise InvalidParameter(f"named zones cannot be assumed: {offset!r}")
        shift = dt.timedelta() if offset == "Z" else (1 if m[1] == "+" else -1) * dt.timedelta(hours=int(m[2]), minutes=int(m[3]))
        return t - shift
    return t.astimezone(dt.UTC).replace(tzinfo=None)


def time_range(text: str, offset: str | None = None) -> tuple[dt.datetime, dt.datetime]:
    """START..END, the end exclusive."""
    start, dots, end = text.partition("..")
    if not dots:
        raise InvalidParameter(f"not START..END: {text!r}")
    return timestamp(start, offset), timestamp(end, offset)


def feature(text: str) -> int | float | bool | str:
    """The first of int, float, bool and string that fits."""
    if re.fullmatch(r"[+-]?\d+", text) and abs(int(text)) < 1 << 63:
        return int(text)
    try:
        if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text):
            return float(text)
    except ValueError:
        pass
    return {"true": True, "false": False}.get(text, text)


def hash_prefix(text: str) -> str:
    if not re.fullmatch(r"[0-9a-fA-F]{1,64}", text):
        raise InvalidParameter("a hash prefix has 1 to 64 hexadecimal digits")
    return text.lower()
