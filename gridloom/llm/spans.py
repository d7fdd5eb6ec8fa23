"""Places of regular expression matches as expressions, without user functions.

A match's place follows from the lengths of what lies between the matches (split by
the same pattern) and of the matches themselves. Places count code points from 0, the end is exclusive.
Patterns must not match the empty string, and must not repeat a group in a way that backtracks
(Java's matcher then recurses): use possessive quantifiers.

What runs over the matches of a text builds its array in parts of PART entries, so a text with m matches is not copied m times.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

SPAN = "struct<s:int,e:int,v:string>"
TAGGED = "struct<s:int,k:int,e:int,v:string>"
PART = 128


def none(kind: str = SPAN) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def running(n: Column, first: Column, step, kind: str) -> Column:
    """What step(p, i) gives for i from 0 to n - 1, as array<kind>: it returns the next p and an entry; p starts as first."""

    def one(acc: Column, i: Column) -> Column:
        p, entry = step(acc["p"], i)
        return F.struct(p.alias("p"), F.concat(acc["out"], F.array(entry)).alias("out"))

    def part(acc: Column, i: Column) -> Column:
        inner = F.aggregate(F.sequence(i, F.least(i + PART, n) - 1), F.struct(acc["p"].alias("p"), none(kind).alias("out")), one)
        return let(inner, lambda x: F.struct(x["p"].alias("p"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    start = F.struct(first.alias("p"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("out"))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(PART)), start, part, lambda acc: F.flatten(acc["out"]))).otherwise(none(kind))


def places(text: Column, pattern: str | Column) -> Column:
    """Leftmost non-overlapping matches as array<struct<s, e, v>>; the pattern may be one of the row's own."""

    def walk(found: Column) -> Column:
        return F.when(F.size(found) == 0, none()).otherwise(let(F.split(text, pattern), lambda gaps: fold(found, gaps)))

    def fold(found: Column, gaps: Column) -> Column:
        def step(p: Column, i: Column):
            v = F.get(found, i)
            s = p + F.length(F.get(gaps, i))
            e = s + F.length(v)
            return e, F.struct(s.alias("s"), e.alias("e"), v.alias("v"))

        return running(F.size(found), F.lit(0), step, SPAN)

    return let(F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0)), walk)


def tagged(spans: Column, kind: int) -> Column:
    """Spans as structs that sort by start, then kind."""
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e"), x["v"].alias("v")))


def joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of sorted, tagged spans, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == kind)).cast("long")


def replaced(text: Column, spans: Column, by: Column) -> Column:
    """text with each span (sorted by start; overlaps are merged into the first) replaced by the name at its kind in by."""

    def step(p: Column, i: Column):
        x = F.get(spans, i)
        new = F.concat(F.substring(text, p + 1, x["s"] - p), F.get(by, x["k"]))
        return F.greatest(p, x["e"]), F.when(x["s"] >= p, new).otherwise("")

    return F.concat(F.array_join(running(F.size(spans), F.lit(0), step, "string"), ""), F.substring(text, last_end(spans) + 1, F.length(text)))


def last_end(spans: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(spans, lambda x: x["e"])), F.lit(0))


def uncovered(spans: Column, base: Column) -> Column:
    """The spans that no span of base covers; both tagged and sorted, spans after base where they start together.

    One pass over both in order of start: what base has reached so far covers a span that ends no later.
    """

    def of(x: Column) -> Column:
        def step(p: Column, i: Column):
            y = F.get(x, i)
            return F.when(y["b"], F.greatest(p, y["x"]["e"])).otherwise(p), F.when(~y["b"] & (y["x"]["e"] > p), y["x"])

        return F.filter(running(F.size(x), F.lit(0), step, TAGGED), lambda y: y.isNotNull())

    return F.when(F.size(spans) == 0, none(TAGGED)).otherwise(let(_merged(spans, base), of))


def apart(spans: Column, base: Column) -> Column:
    """The spans that overlap no span of base: base has not reached their start, and starts again no earlier than their end."""

    def of(x: Column) -> Column:
        n = F.size(x)

        def before(p: Column, i: Column):
            y = F.get(x, i)
            return F.when(y["b"], F.greatest(p, y["x"]["e"])).otherwise(p), ~y["b"] & (p <= y["x"]["s"])

        def after(p: Column, i: Column):
            y = F.get(x, n - 1 - i)
            return F.when(y["b"], y["x"]["s"]).otherwise(p), ~y["b"] & (p >= y["x"]["e"])

        free = lambda l, r: F.filter(
            F.transform(x, lambda y, i: F.when(F.get(l, i) & F.get(r, n - 1 - i), y["x"])),
            lambda y: y.isNotNull(),
        )
        return let(running(n, F.lit(0), before, "boolean"), lambda l: let(running(n, F.lit((1 << 31) - 1), after, "boolean"), lambda r: free(l, r)))

    return F.when((F.size(spans) == 0) | (F.size(base) == 0), spans).otherwise(let(_merged(spans, base), of))


def _merged(spans: Column, base: Column) -> Column:
    """Both as (s, not b, b, x), sorted; base first where they start together."""
    mark = lambda b: lambda x: F.struct(x["s"].alias("s"), F.lit(not b).alias("o"), F.lit(b).alias("b"), x.alias("x"))
    return F.sort_array(F.concat(F.transform(base, mark(True)), F.transform(spans, mark(False))))
