"""Literals as users write them, as columns: the rules of functions.parse without a Python call a row.

What does not parse is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FEATURE
from .elements import FUNCTIONS
from .hashing import DTYPES
from .parse import CATEGORIES, TYPES
from .period import EPOCH
from .period_columns import let


def _plain(text: Column) -> Column:
    return F.lower(F.replace(text, F.lit("_"), F.lit("")))


def _named(text: Column, names: dict[str, object]) -> Column:
    """The value of the name that text is, whatever its case and underscores."""
    out = F.lit(None)
    for name, value in names.items():
        out = F.when(_plain(text) == name.replace("_", "").lower(), F.lit(value)).otherwise(out)
    return out


def series_type(text: Column) -> Column:
    return _named(text, TYPES).cast("int")


def owner_category(text: Column) -> Column:
    return _named(text, {c: c for c in CATEGORIES}).cast("string")


_TUPLE = r"^tuple\(0*([1-9][0-9]*),\s*(\w+)\)$"


def element_type(text: Column) -> Column:
    """(kind, dtype, arity) of an element type: a dtype, tuple(N,dtype) or a function kind."""
    t = F.lower(F.trim(text))
    function = _named(t, {f: f for f in FUNCTIONS})
    inner = F.regexp_extract(t, _TUPLE, 2)
    zero = F.lit(0).cast("long")
    make = lambda kind, dtype, arity: F.struct(kind.alias("kind"), dtype.alias("dtype"), arity.alias("arity"))
    return (
        F.when(function.isNotNull(), make(function.cast("string"), F.lit("f64"), zero))
        .when(t.isin(*DTYPES), make(F.lit("scalar"), t, zero))
        .when(t.rlike(_TUPLE) & inner.isin(*DTYPES), make(F.lit("tuple"), inner, F.regexp_extract(t, _TUPLE, 1).try_cast("long")))
    )


_STAMP = r"^(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d(?::\d\d(?:\.\d{1,9})?)?)(Z|z|[+-]\d\d:?\d\d)?$"


def _shift(zone: Column) -> Column:
    """Milliseconds east of UTC of Z or +hh:mm."""
    digits = F.regexp_replace(zone, "[^0-9]", "")
    minutes = F.substring(digits, 1, 2).try_cast("long") * 60 + F.substring(digits, 3, 2).try_cast("long")
    return F.when(F.upper(zone) == "Z", F.lit(0).cast("long")).otherwise(F.when(zone.startswith("-"), -minutes).otherwise(minutes) * 60_000)


def timestamp(text: Column, offset: str | None = None) -> Column:
    """RFC 3339, epoch milliseconds, or without a zone if a fixed offset is given; as UTC without a zone."""
    epoch = F.timestamp_add("MILLISECOND", F.trim(text).try_cast("long"), F.lit(EPOCH).cast("timestamp_ntz"))

    def read(t: Column) -> Column:
        zone = F.regexp_extract(t, _STAMP, 3)
        stated = F.when(zone != "", zone).otherwise(F.lit(offset).cast("string"))
        local = F.try_to_timestamp(F.concat(F.regexp_extract(t, _STAMP, 1), F.lit(" "), F.regexp_extract(t, _STAMP, 2))).cast("timestamp_ntz")
        return F.when(t.rlike(r"^-?\d+$"), epoch).when(t.rlike(_STAMP), F.timestamp_add("MILLISECOND", -_shift(stated), local))

    return let(F.trim(text), read)


def time_range(text: Column, offset: str | None = None) -> Column:
    """(start, end) of START..END, the end exclusive."""
    both = F.split(text, r"\.\.", 2)
    parts = F.struct(timestamp(F.get(both, F.lit(0)), offset).alias("start"), timestamp(F.get(both, F.lit(1)), offset).alias("end"))
    return F.when(F.size(both) == 2, parts)


def feature(text: Column) -> Column:
    """A feature value of the first kind that fits: int, float, bool, then str."""
    whole = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long"))
    real = F.when(text.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), text.try_cast("double"))
    truth = F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))
    kind = F.when(whole.isNotNull(), "int").when(real.isNotNull(), "float").when(truth.isNotNull(), "bool").otherwise("str")
    fields = {
        "kind": kind,
        "i": whole,
        "f": F.when(whole.isNull(), real),
        "b": truth,
        "s": F.when(kind == "str", text),
    }
    return F.when(text.isNotNull(), F.struct(*[c.alias(k) for k, c in fields.items()]).cast(FEATURE))
