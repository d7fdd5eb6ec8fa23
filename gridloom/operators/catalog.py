"""Listing, discovery, lookups, counts and summaries over the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import IntegrityError, InvalidParameter, NotFound
from ..functions.parse import DERIVED, IRREGULAR, SINGLE
from .filters import ListFilter, type_matches

KEY = [
    "owner_id",
    "owner_type",
    "owner_category",
    "time_series_type",
    "name",
    "resolution",
    "interval",
    "features",
    "initial_timestamp",
    "length",
    "horizon",
    "count",
]


def list_series(associations: DataFrame, timestamp_sets: DataFrame | None = None, f: ListFilter = ListFilter()) -> DataFrame:
    """Whole rows; with timestamp_sets, each irregular series with its instants."""
    rows = f.of(associations)
    return rows if timestamp_sets is None else rows.join(timestamp_sets, "timestamps_hash", "left")


def missing_timestamps(associations: DataFrame, timestamp_sets: DataFrame) -> DataFrame:
    """Irregular series whose vector is not stored."""
    return associations.where(F.col("time_series_type") == IRREGULAR).join(timestamp_sets, "timestamps_hash", "left_anti")


def list_keys(associations: DataFrame, f: ListFilter = ListFilter(), with_hash: bool = False) -> DataFrame:
    return f.of(associations).select(*KEY, *["data_hash"] * with_hash)


def distinct(associations: DataFrame, column: str, f: ListFilter = ListFilter()) -> DataFrame:
    """Distinct values that are not null, in ascending (text) order."""
    return f.of(associations).select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def owner_ids(associations: DataFrame, category: str, type_: int | None = None, resolution: str | None = None) -> DataFrame:
    return ListFilter(owner_category=category, time_series_type=type_, resolution=resolution).of(associations).select("owner_id").distinct()


def timeline_cohorts(associations: DataFrame, f: ListFilter = ListFilter()) -> DataFrame:
    return f.of(associations).where(F.col("timestamps_hash").isNotNull()).groupBy("timestamps_hash").agg(F.count(F.lit(1)).alias("series"))


def array_groups(associations: DataFrame) -> DataFrame:
    """Each array with the series that share it."""
    return associations.groupBy("data_hash").agg(F.count(F.lit(1)).alias("series"), F.array_sort(F.collect_list("assoc_id")).alias("assoc_ids"))


def referenced_arrays(associations: DataFrame) -> DataFrame:
    return associations.select("data_hash", "element_type").distinct()


def metadata_of(associations: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """One row for each key (ordinal, *on), in order; an error if one is missing."""
    k = keys.select("ordinal", *[F.col(c).alias(f"__{c}") for c in on])
    same = [F.col(f"__{c}").eqNullSafe(F.col(c)) for c in on]
    rows = k.join(associations, same, "left")
    if rows.where(F.col("assoc_id").isNull()).limit(1).count():
        raise NotFound("a key matches no series")
    return rows.drop(*[f"__{c}" for c in on]).orderBy("ordinal")


def found(associations: DataFrame, f: ListFilter) -> DataFrame:
    """One row: whether any series matches; no more than one is read."""
    return f.of(associations).select(F.lit(1)).limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


def exists(associations: DataFrame, f: ListFilter) -> bool:
    return found(associations, f).first()[0]


def by_key(associations: DataFrame, key: ListFilter) -> DataFrame:
    """The one row of a key: its features are all that the row has. None, or more than one, is an error."""
    rows = key.of(associations).where(F.size("features") == len(key.features))
    n = rows.limit(2).count()
    if n == 0:
        raise NotFound(f"no series has the key {key}")
    if n > 1:
        raise IntegrityError(f"more than one series has the key {key}")
    return rows


def is_empty(*tables: DataFrame) -> bool:
    return not any(t.limit(1).count() for t in tables)


def resolve_forecast(associations: DataFrame, f: ListFilter):
    """The one forecast of attributes, whichever way it is stored."""
    rows = f.of(associations).where(F.col("time_series_type") > IRREGULAR).limit(11).collect()
    if not rows:
        raise NotFound("no forecast matches")
    if len(rows) > 1:
        raise InvalidParameter("the forecast is ambiguous: " + ", ".join(f"{r['resolution']}/{r['interval']}" for r in rows[:10]))
    return rows[0]


def array_references(associations: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Static and derived series of each array."""
    static, derived = F.count_if(F.col("time_series_type") == SINGLE), F.count_if(F.col("time_series_type") == DERIVED)
    return associations.groupBy(*(by or ["data_hash"])).agg(static.alias("static_refs"), derived.alias("derived_refs"))


def counts_by_type(associations: DataFrame) -> DataFrame:
    return associations.groupBy("time_series_type").agg(F.count(F.lit(1)).alias("series")).orderBy("time_series_type")


def store_counts(associations: DataFrame) -> DataFrame:
    static = F.col("time_series_type") <= IRREGULAR
    return associations.agg(
        F.countDistinct("owner_id", "owner_category").alias("owners"),
        F.count_if(static).alias("static"),
        F.count_if(~static).alias("forecasts"),
    )


def detailed_counts(associations: DataFrame) -> DataFrame:
    """Distinct owners of each category and distinct arrays of static series and of forecasts, in one pass."""
    static = F.col("time_series_type") <= IRREGULAR
    of = lambda c: F.countDistinct(F.when(F.col("owner_category") == c, F.col("owner_id")))
    return associations.agg(
        of("Component").alias("components"),
        of("SupplementalAttribute").alias("attributes"),
        F.countDistinct(F.when(static, F.col("data_hash"))).alias("static_arrays"),
        F.countDistinct(F.when(~static, F.col("data_hash"))).alias("forecast_arrays"),
    )


def distinct_arrays(associations: DataFrame) -> DataFrame:
    return associations.agg(F.countDistinct("data_hash").alias("arrays"))


STATIC_GROUP = ["owner_type", "owner_category", "time_series_type", "name", "initial_timestamp", "resolution", "length"]
FORECAST_GROUP = ["owner_type", "owner_category", "time_series_type", "name", "initial_timestamp", "resolution", "horizon", "interval", "count"]


def static_summary(associations: DataFrame) -> DataFrame:
    return associations.where(F.col("time_series_type") <= IRREGULAR).groupBy(*STATIC_GROUP).agg(F.count(F.lit(1)).alias("series"))


def forecast_summary(associations: DataFrame) -> DataFrame:
    return associations.where(F.col("time_series_type") > IRREGULAR).groupBy(*FORECAST_GROUP).agg(F.count(F.lit(1)).alias("series"))


def static_grids(associations: DataFrame, resolution: str | None = None, category: str | None = None) -> DataFrame:
    rows = ListFilter(time_series_type=SINGLE, resolution=resolution, owner_category=category).of(associations)
    return rows.select("resolution", "initial_timestamp", "length").distinct().orderBy("resolution", "initial_timestamp", "length")


def static_consistency(associations: DataFrame, resolution: str | None = None) -> DataFrame:
    """The one grid of each resolution; grids > 1 is what check_static_consistency refuses."""
    g = static_grids(associations, resolution).groupBy("resolution")
    return g.agg(F.min("initial_timestamp").alias("initial_timestamp"), F.min("length").alias("length"), F.count(F.lit(1)).alias("grids"))


def check_static_consistency(associations: DataFrame, resolution: str | None = None) -> DataFrame:
    out = static_consistency(associations, resolution)
    if out.where("grids > 1").limit(1).count():
        raise IntegrityError("series of one resolution have several grids")
    return out.drop("grids")


def forecast_parameters(associations: DataFrame, resolution: str | None = None, interval: str | None = None) -> DataFrame:
    """Of the first forecast by type, then by the order of insertion."""
    rows = ListFilter(resolution=resolution, interval=interval).of(associations).where(F.col("time_series_type") > IRREGULAR)
    return rows.orderBy("time_series_type", "assoc_id").limit(1).select("horizon", "interval", "count", "resolution", "initial_timestamp")


IDENTITY = ["owner_id", "owner_category", "time_series_type", "name", "resolution", "interval", "features_hash"]
PERCENTILES = (5, 25, 50, 75, 95)


def finite_values(values: str) -> Column:
    return F.filter(F.transform(values, lambda x: x.cast("double")), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def statistics(rows: DataFrame, by: list[str], values: str = "values") -> DataFrame:
    """Of the finite values of each series: counts, first, last, extremes, mean, deviation and percentiles.

    Each array is sorted in its own row: no explode, no exchange.
    """
    out = rows.select(*by, F.col(values).alias("__v"), F.array_sort(finite_values(values)).alias("__s"))
    n = F.size("__s")
    total = lambda f: F.aggregate(F.transform("__s", f), F.lit(0.0), lambda a, x: a + x)
    out = out.withColumn("__mean", F.when(n > 0, total(lambda x: x) / n))

    def percentile(p: int) -> Column:
        at = F.lit(p / 100) * (n - 1)
        low, high = F.get("__s", F.floor(at).cast("int")), F.get("__s", F.ceil(at).cast("int"))
        return F.when(n > 0, low + (at - F.floor(at)) * (high - low))

    deviation = F.when(n == 1, F.lit(0.0)).when(
        n > 1,
        F.sqrt(F.aggregate(F.transform("__s", lambda x: (x - F.col("__mean")) * (x - F.col("__mean"))), F.lit(0.0), lambda a, x: a + x) / (n - 1)),
    )
    return out.select(
        *by,
        F.size("__v").cast("long").alias("num_elements"),
        (F.size("__v") - n).cast("long").alias("non_finite"),
        F.get("__v", F.lit(0)).cast("double").alias("first"),
        F.get("__v", F.size("__v") - 1).cast("double").alias("last"),
        F.get("__s", F.lit(0)).alias("min"),
        F.get("__s", n - 1).alias("max"),
        F.col("__mean").alias("mean"),
        deviation.alias("stddev"),
        *[percentile(p).alias(f"p{p}") for p in PERCENTILES],
    )


def boolean_statistics(rows: DataFrame, by: list[str], values: str = "values") -> DataFrame:
    true = F.size(F.filter(values, lambda x: x))
    return rows.select(*by, true.cast("long").alias("true_count"), (F.size(values) - true).cast("long").alias("false_count"))


def count_of_type(associations: DataFrame, code: int) -> DataFrame:
    """How many series of a type there are; views count where dense forecasts are asked for only if code says so."""
    return associations.where(F.col("time_series_type") == code).agg(F.count(F.lit(1)).alias("series"))


def identities(associations: DataFrame, code: int) -> DataFrame:
    return associations.where(F.col("time_series_type") == code).select(*IDENTITY, "horizon")


def first_listed(associations: DataFrame, n: int) -> DataFrame:
    """The first n rows in the order of insertion."""
    return associations.orderBy("assoc_id").limit(n)


def typed_order() -> list[Column]:
    """The order of exports: identity by type, features by their sorted entries."""
    return [
        F.col(c) for c in ("owner_id", "owner_category", "time_series_type", "name")
    ] + [F.coalesce(F.col(c), F.lit("")) for c in ("resolution", "interval")] + [F.array_sort(F.map_entries("features"))]


def of_type(associations: DataFrame, code: int) -> DataFrame:
    return associations.where(type_matches(F.col("time_series_type"), code))
