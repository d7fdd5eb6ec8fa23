"""Merging one catalog with its arrays into another.

A view on a single series is stored as catalog rows alone. What is merged is what a read of it gives: a dense forecast,
so each view's windows are gathered into an array [steps, count, ...] of their own. Views that share source, horizon,
interval and count share the gathered array, which is made and hashed once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DuplicateTimeSeries, InvalidParameter, NotFound
from ..functions.hashing import content_hash
from ..functions.parse import DERIVED, DETERMINISTIC
from ..functions.period_columns import Periods
from ..functions.tables import ARRAY_ROWS, held, written
from ..schema import IDENTITY
from .ranges import long, step_width, windows_of_single
from .sets import chosen, family_conflicts, first_rows

#: What decides the dense array of a view.
PLAN = ("data_hash", "resolution", "horizon", "interval", "count")
FAMILY = [c for c in IDENTITY if c != "time_series_type"]


@dataclass(frozen=True)
class Catalog:
    """Associations with the arrays (data_hash, dtype, shape, values, exact) that they refer to."""

    associations: DataFrame
    arrays: DataFrame


def _hashed(arrays: DataFrame) -> DataFrame:
    """(..., new_hash): the content hash of dtype, shape and values."""
    return arrays.withColumn("new_hash", content_hash(*map(F.col, ("dtype", "shape", "values", "exact"))))


def dense_arrays(views: DataFrame, arrays: DataFrame) -> DataFrame:
    """(*PLAN, new_hash, dtype, shape, values, exact): the dense array of each distinct plan of views."""
    plans = views.groupBy(*PLAN).agg(F.first("element_shape").alias("element_shape"), F.first("time_series_type").alias("time_series_type"))
    resolution, interval = Periods.of(F.col("resolution")), Periods.of(F.col("interval"))
    steps = resolution.divide_into(Periods.of(F.col("horizon")))
    stride = F.when(interval.n == 0, long(0)).otherwise(resolution.divide_into(interval))
    rows = plans.withColumns({"__steps": steps, "__stride": stride, "__width": step_width(), "__count": F.col("count").cast("long")})
    rows = held(rows).join(arrays.select("data_hash", "dtype", "values", "exact"), "data_hash")
    of = lambda c: windows_of_single(F.col(c), F.col("__steps"), long(0), F.col("__count"), F.col("__stride"), F.col("__width"))
    gathered = {c: F.when(F.col(c).isNotNull(), of(c)) for c in ("values", "exact")}
    shape = F.concat(F.array("__steps", "__count").cast("array<int>"), F.coalesce("element_shape", F.expr("cast(array() as array<int>)")))
    rows = rows.withColumns({f"__{c}": v for c, v in gathered.items()} | {"shape": shape})
    rows = rows.select(*PLAN, "dtype", "shape", F.col("__values").alias("values"), F.col("__exact").alias("exact"))
    return _hashed(rows)


def landed(source: Catalog) -> Catalog:
    """source with every view as the dense forecast that it shows, and the arrays of those beside the others.

    A view whose array is not stored, or whose plan gives no whole number of steps, is an error.
    """
    is_view = F.col("time_series_type") == DERIVED
    views = source.associations.where(is_view)
    rest = source.associations.where(~F.coalesce(is_view, F.lit(False)))
    arrays = source.arrays.join(held(rest.select("data_hash").distinct()), "data_hash", "left_semi").select(*source.arrays.columns)
    if views.isEmpty():
        return Catalog(rest, arrays)
    plans = views.select(*PLAN).distinct()
    resolution, horizon, interval = (Periods.of(F.col(c)) for c in ("resolution", "horizon", "interval"))
    whole = resolution.divide_into(horizon).isNotNull() & ((interval.n == 0) | resolution.divide_into(interval).isNotNull())
    if plans.where(~F.coalesce(whole, F.lit(False))).limit(1).count():
        raise InvalidParameter("a view's horizon or interval is no multiple of its resolution")
    if plans.join(source.arrays.select("data_hash"), "data_hash", "left_anti").limit(1).count():
        raise NotFound("a view's array is not stored")
    dense = written(dense_arrays(views, source.arrays).withColumn("__row", F.monotonically_increasing_id()), "dense", ARRAY_ROWS)
    named = dense.select(*PLAN, "new_hash", F.element_at("shape", 1).cast("long").alias("__steps"))
    changed = {
        "data_hash": F.col("new_hash"),
        "element_shape": F.concat(F.array("count").cast("array<int>"), F.coalesce("element_shape", F.expr("cast(array() as array<int>)"))),
        "length": F.col("__steps").cast(source.associations.schema["length"].dataType),
        "time_series_type": F.lit(DETERMINISTIC).cast(source.associations.schema["time_series_type"].dataType),
    }
    moved = views.join(named, list(PLAN)).withColumns(changed).select(*source.associations.columns)
    new = dense.withColumn("data_hash", F.col("new_hash"))
    once = first_rows(new).join(arrays.select("data_hash"), "data_hash", "left_anti")
    return Catalog(rest.unionByName(moved), arrays.unionByName(chosen(new, once).select(*source.arrays.columns)))


def _equal(a: str, b: str, columns) -> F.Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def clashes(into: DataFrame, other: DataFrame) -> DataFrame:
    """The rows of other whose identity, as it lands, stands in into."""
    as_dense = F.when(F.col("time_series_type") == DERIVED, F.lit(DETERMINISTIC)).otherwise(F.col("time_series_type"))
    other = other.withColumn("time_series_type", as_dense)
    return other.alias("r").join(into.alias("l"), _equal("l", "r", IDENTITY), "left_semi")


def _without(into: DataFrame, other: DataFrame) -> DataFrame:
    """into without what other replaces: equal identities, a view and a dense forecast counting as one."""
    kind = lambda side: F.when(F.col(f"{side}.time_series_type") == DERIVED, DETERMINISTIC).otherwise(F.col(f"{side}.time_series_type"))
    same = _equal("l", "r", FAMILY) & kind("l").eqNullSafe(kind("r"))
    return into.alias("l").join(other.alias("r"), same, "left_anti").select("l.*")


def parts(into: Catalog, source: Catalog, replace: bool = False) -> tuple[DataFrame, Catalog]:
    """The associations of into that stay, and what comes from source.

    With replace, series of into with the identity of one of source give way. Without it such a series is an error, and so
    is, in any case, a family that would hold both a view and a dense forecast.
    """
    kept = _without(into.associations, source.associations) if replace else into.associations
    if not replace and clashes(kept, source.associations).limit(1).count():
        raise DuplicateTimeSeries("a series of this identity exists")
    new = landed(source)
    if family_conflicts(new.associations, kept).limit(1).count():
        raise DuplicateTimeSeries("a forecast of this family is stored as a view")
    return kept, new


def merged(into: Catalog, source: Catalog, replace: bool = False) -> Catalog:
    """into with the series of source; see parts()."""
    kept, new = parts(into, source, replace)
    associations = kept.unionByName(new.associations)
    arrays = new.arrays.join(held(into.arrays.select("data_hash")), "data_hash", "left_anti").select(*into.arrays.columns)
    own = into.arrays
    if replace:
        own = own.join(held(associations.select("data_hash").distinct()), "data_hash", "left_semi").select(*into.arrays.columns)
    return Catalog(associations, own.unionByName(arrays))
