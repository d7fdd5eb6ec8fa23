"""Periods: a fixed span in milliseconds, or calendar months; as values and as column arithmetic.

Instants are TIMESTAMP_NTZ in UTC; the session's time zone must be UTC.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidParameter

#: Milliseconds of the fixed designators, largest first (fixed values).
SPANS = (("D", 86_400_000), ("H", 3_600_000), ("M", 60_000))
EPOCH = dt.datetime(1970, 1, 1)
_FIXED = re.compile(r"(-?)P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:\.(\d{1,3}))?S)?)?")
_MONTHS = re.compile(r"(-?)P(?:(\d+)Y)?(?:(\d+)M)?")


@dataclass(frozen=True, order=False)
class Period:
    """kind: fixed (n milliseconds) or months (n months). Never equal across kinds."""

    kind: str
    n: int

    @staticmethod
    def parse(text: str) -> Period:
        """From ISO 8601: W, D, H, M, S with up to three decimals, or Y and M; never both."""
        if text[-1:] not in ("", "P", "T", "-"):
            if m := _MONTHS.fullmatch(text):
                sign, years, months = m.groups()
                return Period("months", (-1 if sign else 1) * (12 * int(years or 0) + int(months or 0)))
            if m := _FIXED.fullmatch(text):
                sign, weeks, *rest, seconds, part = m.groups()
                ms = 604_800_000 * int(weeks or 0) + sum(k * int(x or 0) for (_, k), x in zip(SPANS, rest, strict=True))
                ms += 1000 * int(seconds or 0) + int((part or "").ljust(3, "0"))
                if abs(ms) < 1 << 63:
                    return Period("fixed", -ms if sign else ms)
        raise InvalidParameter(f"not an ISO 8601 period: {text!r} (for example PT1H, P1D or P1M)")

    def iso(self) -> str:
        """The one text of the value."""
        n, sign = abs(self.n), "-" if self.n < 0 else ""
        if n == 0:
            return "PT0S"
        if self.kind == "months":
            return f"{sign}P{n // 12}Y" if n % 12 == 0 else f"{sign}P{n}M"
        parts = {}
        for name, span in SPANS:
            parts[name], n = divmod(n, span)
        seconds = f"{n // 1000}.{n % 1000:03d}".rstrip("0").rstrip(".") if n else ""
        time = "".join(f"{parts[k]}{k}" for k in "HM" if parts[k]) + (f"{seconds}S" if seconds else "")
        return f"{sign}P" + (f"{parts['D']}D" if parts["D"] else "") + (f"T{time}" if time else "")

    @property
    def positive(self) -> bool:
        return self.n > 0

    @property
    def zero(self) -> bool:
        return self.n == 0

    def same_kind(self, other: Period) -> bool:
        return self.kind == other.kind

    def divide_into(self, other: Period) -> int:
        """other / self, an exact positive number of the same kind."""
        if not self.same_kind(other) or self.n <= 0 or other.n <= 0 or other.n % self.n:
            raise InvalidParameter(f"{other.iso()} is not a positive multiple of {self.iso()}")
        return other.n // self.n

    def add_to(self, t: dt.datetime, k: int) -> dt.datetime:
        """t plus k periods, always counted from t, a day beyond the month's end clamped."""
        if self.kind == "fixed":
            return t + dt.timedelta(milliseconds=k * self.n)
        month = t.year * 12 + t.month - 1 + k * self.n
        y, m = divmod(month, 12)
        last = (dt.datetime(y + (m == 11), (m + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
        return t.replace(year=y, month=m + 1, day=min(t.day, last))

    def floor_steps(self, start: dt.datetime, at: dt.datetime) -> int:
        """Whole periods from start to at, not below 0."""
        if at <= start:
            return 0
        if self.kind == "fixed":
            return (at - start) // dt.timedelta(milliseconds=self.n)
        k = (at.year * 12 + at.month - start.year * 12 - start.month) // self.n
        return max(0, k - (self.add_to(start, k) > at))

    def ceil_steps(self, start: dt.datetime, at: dt.datetime) -> int:
        k = self.floor_steps(start, at)
        return k + (self.add_to(start, k) < at)

    def steps_between(self, start: dt.datetime, at: dt.datetime) -> int:
        """The k with start + k periods = at; an error if there is none."""
        k = self.floor_steps(start, at) if self.n > 0 else 0
        if at < start or self.add_to(start, k) != at:
            raise InvalidParameter(f"{at.isoformat()} is not on the grid of {self.iso()} from {start.isoformat()}")
        return k

    # the same as columns
    def add(self, t: Column, k: Column) -> Column:
        if self.kind == "fixed":
            return t + F.lit(dt.timedelta(milliseconds=self.n)) * k.cast("long")
        return t + F.make_ym_interval(F.lit(0), (k * self.n).cast("int"))

    def floor(self, start: Column, at: Column) -> Column:
        if self.kind == "fixed":
            return F.greatest(F.lit(0), F.floor((micros(at) - micros(start)) / (1000 * self.n))).cast("long")
        months = (F.year(at) * 12 + F.month(at) - F.year(start) * 12 - F.month(start)).cast("long")
        k = F.greatest(F.lit(0), F.floor(months / self.n)).cast("long")
        return F.greatest(F.lit(0).cast("long"), F.when(self.add(start, k) > at, k - 1).otherwise(k))

    def ceil(self, start: Column, at: Column) -> Column:
        k = self.floor(start, at)
        return F.when(self.add(start, k) < at, k + 1).otherwise(k)

    def steps(self, start: Column, at: Column) -> Column:
        """The k with start + k periods = at, null if there is none."""
        k = self.floor(start, at)
        return F.when((at >= start) & (self.add(start, k) == at), k)


def micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def instant(t: dt.datetime) -> Column:
    return F.lit(t).cast("timestamp_ntz")


def whole_millis(t: Column) -> Column:
    """Stored instants are whole milliseconds."""
    return micros(t) % 1000 == 0


def wire_instant(t: Column) -> Column:
    """RFC 3339 text, without a fraction on whole seconds, else with three digits."""
    ms = F.floor(micros(t) / 1000)
    at = F.timestamp_millis(ms).cast("timestamp_ntz")
    return F.when(ms % 1000 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def iso_of(kind: Column, n: Column) -> Column:
    """Canonical text of period columns."""
    a = F.abs(n)
    sign = F.when(n < 0, F.lit("-P")).otherwise(F.lit("P"))
    months = F.when(a % 12 == 0, F.concat(sign, F.floor(a / 12).cast("string"), F.lit("Y"))).otherwise(F.concat(sign, a.cast("string"), F.lit("M")))
    part = lambda x, u: F.when(x > 0, F.concat(x.cast("string"), F.lit(u))).otherwise(F.lit(""))
    days, rest = F.floor(a / 86_400_000), a % 86_400_000
    hours, minutes, ms = F.floor(rest / 3_600_000), F.floor(rest % 3_600_000 / 60_000), rest % 60_000
    whole = F.floor(ms / 1000).cast("string")
    fraction = F.rtrim(F.lpad((ms % 1000).cast("string"), 3, "0"), F.lit("0"))
    seconds = F.when(ms == 0, F.lit("")).when(ms % 1000 == 0, F.concat(whole, F.lit("S"))).otherwise(
        F.concat(whole, F.lit("."), fraction, F.lit("S")),
    )
    time = F.concat(part(hours, "H"), part(minutes, "M"), seconds)
    fixed = F.concat(sign, part(days, "D"), F.when(time == "", F.lit("")).otherwise(F.concat(F.lit("T"), time)))
    return F.when(n == 0, F.lit("PT0S")).when(kind == "months", months).otherwise(fixed)
