"""Bulk reads over a range, merges, slots and feature sets: catalog and arrays together."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.period import Period, instant
from ..functions.period_columns import Periods
from ..functions.tables import held
from ..operators import merging, ranges, series
from ..operators.merging import Catalog
from . import fixtures as fx

HOUR, DAY, TWO_DAYS = map(Period.parse, ("PT1H", "P1D", "P2D"))
_OWNER = ["owner_id", "name"]


def _catalog(spark, d) -> Catalog:
    return Catalog(fx.associations(spark, d), fx.arrays(spark, d))


# ranges over all kinds of series
_STATIC = dt.datetime(2000, 5, 15), dt.datetime(2024, 1, 5, 12, 30)
_WINDOWS = dt.datetime(2024, 1, 4), dt.datetime(2024, 1, 9, 1)


def _range(where: str, span):
    def read(spark, d):
        keys = fx.associations(spark, d).where(where).select("assoc_id", F.monotonically_increasing_id().alias("ordinal"))
        held = fx.associations(spark, d), fx.arrays(spark, d), fx.timestamp_sets(spark, d)
        return ranges.read_ranges(keys, ["assoc_id"], *held, *map(instant, span))

    return read


def _static_range(spark, d):
    """Every step that is left, with its instant, of hourly, monthly and irregular series alike."""
    cut = _range("time_series_type < 2", _STATIC)(spark, d)
    # the resolution is parsed once a series, before its steps are exploded
    period = Periods.of(F.col("resolution"))
    cut = cut.select("assoc_id", "initial_timestamp", "timestamps", "values", period.kind.alias("__kind"), period.n.alias("__n"))
    stamped = F.transform("values", lambda v, i: F.struct(v.alias("v"), F.get("timestamps", i).alias("t")))
    steps = cut.select("assoc_id", "initial_timestamp", "__kind", "__n", F.posexplode(stamped).alias("idx", "x"))
    i = F.col("idx").cast("long")
    t = F.coalesce(F.col("x.t"), Periods(F.col("__kind"), F.col("__n")).add(F.col("initial_timestamp"), i))
    return steps.select("assoc_id", i.alias("idx"), t.alias("t"), F.col("x.v").cast("long").alias("v"))


def _window_range(spark, d):
    """The windows that are left of views and dense forecasts, both as [steps, count] arrays."""
    cut = _range("time_series_type > 1", _WINDOWS)(spark, d)
    n = F.col("count").cast("int")
    place = cut.select("assoc_id", "initial_timestamp", "count", F.posexplode("values").alias("place", "v"))
    at = {"h": F.floor(F.col("place") / n), "w": F.col("place") % n, "v": F.col("v")}
    return place.select("assoc_id", "initial_timestamp", *[c.cast("long").alias(k) for k, c in at.items()])


_STATIC_SQL = f"""
WITH {fx.SQL_ASSOC}, {fx.SQL_HOURLY}, {fx.SQL_MONTHLY}, {fx.SQL_IRREGULAR},
steps AS (
  SELECT assoc_id, t, v, false AS regular, NULL AS next FROM assoc a JOIN activity x USING (owner_id) WHERE time_series_type = 1
  UNION ALL SELECT assoc_id, t, v, true, t + INTERVAL 1 HOUR FROM assoc JOIN hourly USING (owner_id, name) WHERE time_series_type = 0
  UNION ALL SELECT assoc_id, t, v, true, t + INTERVAL 1 MONTH FROM assoc JOIN monthly USING (name) WHERE resolution = 'P1M'),
kept AS (
  SELECT * FROM steps WHERE t < TIMESTAMP '2024-01-05 12:30:00'
    AND CASE WHEN regular THEN next > TIMESTAMP '2000-05-15' ELSE t >= TIMESTAMP '2000-05-15' END)
SELECT assoc_id, row_number() OVER (PARTITION BY assoc_id ORDER BY t, v) - 1 AS idx, t, v FROM kept"""
_WINDOW_SQL = f"""
WITH {fx.SQL_ASSOC}, {fx.SQL_HOURLY},
w AS (SELECT assoc_id, owner_id, name, CASE time_series_type WHEN 3 THEN 48 ELSE 24 END AS steps FROM assoc WHERE time_series_type > 1)
SELECT assoc_id, TIMESTAMP '2024-01-04' AS initial_timestamp, idx - (3 + k.w) * 24 AS h, k.w::BIGINT AS w, v
FROM w JOIN range(6) k(w) ON true JOIN hourly USING (owner_id, name) WHERE idx >= (3 + k.w) * 24 AND idx < (3 + k.w) * 24 + steps"""


# merging
def _halves(spark, d):
    """Catalogs of the owners whose ids are odd, and of those whose ids are even (who have the views)."""
    whole = _catalog(spark, d)
    of = lambda where: Catalog(whole.associations.where(where), whole.arrays)
    return of("owner_id % 2 = 1"), of("owner_id % 2 = 0")


def _merged_windows(spark, d):
    """Windows of the dense forecasts that views became."""
    merged = merging.merged(*_halves(spark, d))
    rows = merged.associations.where("time_series_type = 2 and horizon = 'P2D'").join(merged.arrays.select("data_hash", "values"), "data_hash")
    out = series.dense_windows(rows, _OWNER, 48, HOUR, DAY)
    return out.select(*_OWNER, "w", "h", F.col("v").cast("long").alias("v"), "issue_time", "target_time")


def _doubled(catalog: Catalog) -> Catalog:
    """Every array with all values twice as large, under other hashes."""
    again = F.sha2(F.concat(F.lit("twice:"), F.col("data_hash")), 256)
    twice = catalog.arrays.withColumns({"data_hash": again, "values": F.transform("values", lambda x: 2 * x)})
    return Catalog(catalog.associations.withColumn("data_hash", again), twice)


def _merged_replaced(spark, d):
    """All single series with those of owners 1 to 5 merged again with doubled values: the total of each."""
    whole = _catalog(spark, d)
    static = Catalog(whole.associations.where("time_series_type < 2"), whole.arrays)
    few = _doubled(
        Catalog(
            static.associations.where("owner_id between 1 and 5"),
            static.arrays.join(held(static.associations.where("owner_id between 1 and 5").select("data_hash")), "data_hash", "left_semi"),
        ),
    )
    merged = merging.merged(static, few, replace=True)
    # an array's total is taken before the join, which then carries no values
    totals = merged.arrays.select("data_hash", F.aggregate("values", F.lit(0.0), lambda a, x: a + x).cast("long").alias("total"))
    return merged.associations.join(totals, "data_hash").select("owner_id", "name", "time_series_type", "total")


def _clashes(spark, d):
    """What of the owners 1 to 20 stands in the catalog of the odd owners already, as it would land."""
    odd, _ = _halves(spark, d)
    some = fx.associations(spark, d).where("owner_id between 1 and 20")
    return merging.clashes(odd.associations, some).select("owner_id", "name", F.col("time_series_type").cast("int").alias("time_series_type"))


_VIEWS = """
SELECT owner_id, name, k.w::BIGINT AS w, idx - k.w * 24 AS h, v, TIMESTAMP '2024-01-01' + to_days(k.w::INT) AS issue_time, t AS target_time
FROM hourly JOIN range(29) k(w) ON idx BETWEEN k.w * 24 AND k.w * 24 + 47"""

QUERIES = {
    "SLC_6_range_of_all_static": (_static_range, _STATIC_SQL),
    "SLC_6_range_of_all_forecasts": (_window_range, _WINDOW_SQL),
    "SET_2_merge_windows": (_merged_windows, f"WITH {fx.SQL_HOURLY} {_VIEWS} WHERE owner_id % 2 = 0"),
    "SET_2_merge_replace": (
        _merged_replaced,
        f"""WITH {fx.SQL_ASSOC}, {fx.SQL_HOURLY}, {fx.SQL_MONTHLY}, {fx.SQL_IRREGULAR},
x AS (
  SELECT owner_id, name, 0 AS time_series_type, v FROM hourly
  UNION ALL SELECT owner_id, 'activity', 1, v FROM activity
  UNION ALL SELECT 1000000 + CAST(name[1] AS BIGINT), name, 0, v FROM monthly)
SELECT owner_id, name, time_series_type, sum(v * CASE WHEN owner_id BETWEEN 1 AND 5 THEN 2 ELSE 1 END)::BIGINT AS total FROM x GROUP BY ALL""",
    ),
    "SET_2_merge_clashes": (
        _clashes,
        f"""WITH {fx.SQL_ASSOC} SELECT owner_id, name, CASE time_series_type WHEN 3 THEN 2 ELSE time_series_type END AS time_series_type
FROM assoc WHERE owner_id BETWEEN 1 AND 20 AND owner_id % 2 = 1""",
    ),
}
