"""Periods that differ by row: kind and number are columns, so that one plan serves series of any resolution.

The arithmetic is that of functions.period.Period. What does not parse, or has no exact result, is null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .period import SPANS, micros


def let(value: Column, fn) -> Column:
    """fn(value), with value evaluated once a row however often fn uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


_MONTHS = r"^(-?)P(?=\d)(?:(\d+)Y)?(?:(\d+)M)?$"
_FIXED = r"^(-?)P(?=[\dT])(?:(\d+)W)?(?:(\d+)D)?(?:T(?=\d)(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:\.(\d{1,3}))?S)?)?$"
WEEK = 604_800_000


@dataclass(frozen=True)
class Periods:
    """kind: fixed (n milliseconds) or months (n months)."""

    kind: Column
    n: Column

    @staticmethod
    def of(text: Column) -> Periods:
        """From ISO 8601 texts, by the rules of Period.parse."""
        months, fixed = text.rlike(_MONTHS), text.rlike(_FIXED)
        number = lambda pattern, i: F.coalesce(F.regexp_extract(text, pattern, i).try_cast("long"), F.lit(0).cast("long"))
        sign = F.when(text.startswith("-"), -1).otherwise(1)
        ms = number(_FIXED, 2) * WEEK + number(_FIXED, 6) * 1000
        for i, (_, span) in enumerate(SPANS):
            ms = ms + number(_FIXED, 3 + i) * span
        ms = ms + F.coalesce(F.rpad(F.regexp_extract(text, _FIXED, 7), 3, "0").try_cast("long"), F.lit(0))
        n = F.when(months, number(_MONTHS, 2) * 12 + number(_MONTHS, 3)).when(fixed, ms)
        return Periods(F.when(months, "months").when(fixed, "fixed"), (n * sign).cast("long"))

    @property
    def _months(self) -> Column:
        return F.when(self.kind == "months", self.n)

    @property
    def _millis(self) -> Column:
        return F.when(self.kind == "fixed", self.n)

    def add(self, t: Column, k: Column) -> Column:
        """t plus k periods, counted from t; a day beyond the month's end is clamped."""
        by_month = t + F.make_ym_interval(F.lit(0), (k * self._months).cast("int"))
        by_milli = F.timestamp_add("MILLISECOND", k.cast("long") * self._millis, t)
        return F.when(self.kind == "months", by_month).otherwise(by_milli)

    def floor(self, start: Column, at: Column) -> Column:
        """Whole periods from start to at, not below 0; null for a period that is not positive."""
        span = 1000 * F.when(self._millis > 0, self._millis)
        by_milli = F.floor((micros(at) - micros(start) - F.pmod(micros(at) - micros(start), span)) / span)
        between = F.year(at) * 12 + F.month(at) - F.year(start) * 12 - F.month(start)
        k = F.floor(between / F.when(self._months > 0, self._months)).cast("long")
        by_month = let(k, lambda k: F.when(self.add(start, k) > at, k - 1).otherwise(k))
        found = F.when(self.kind == "months", by_month).otherwise(by_milli).cast("long")
        return F.when(self.n > 0, F.greatest(found, F.lit(0).cast("long")))

    def ceil(self, start: Column, at: Column) -> Column:
        return let(self.floor(start, at), lambda k: F.when(self.add(start, k) < at, k + 1).otherwise(k))

    def steps(self, start: Column, at: Column) -> Column:
        """The k with start + k periods = at, null if there is none."""
        return let(self.floor(start, at), lambda k: F.when((at >= start) & (self.add(start, k) == at), k))

    def divide_into(self, other: Periods) -> Column:
        """other / self, where that is a positive whole number of the same kind."""
        fits = (self.kind == other.kind) & (self.n > 0) & (other.n > 0)
        n = F.when(fits, self.n)
        return F.when(other.n % n == 0, F.floor(other.n / n)).cast("long")
