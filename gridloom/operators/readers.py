"""Sweeps: the values of all series at each timestamp, as one job."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..functions.elements import ElementType
from ..functions.parse import DERIVED, DETERMINISTIC, IRREGULAR, SINGLE
from ..functions.period import Period
from .filters import ListFilter
from .series import dense_windows, derived_windows, steps


def columns_of(associations: DataFrame) -> DataFrame:
    """Series in the order of a reader's columns: by element type and shape, owner, category, name and features."""
    known = [r[0] for r in associations.select("element_type").distinct().collect()]
    order = {t: i for i, t in enumerate(sorted(known, key=lambda t: ElementType.parse(t).sort_key()))}
    rank = F.coalesce(*[F.when(F.col("element_type") == t, F.lit(i)) for t, i in order.items()]) if order else F.lit(0)
    return associations.orderBy(rank, "element_shape", "owner_id", "owner_category", "name", F.array_sort(F.map_entries("features")))


def check_static(associations: DataFrame) -> None:
    """Single series of one grid, or irregular ones of one timestamp vector."""
    types = {r[0] for r in associations.select("time_series_type").distinct().collect()}
    if types == {SINGLE}:
        if associations.select("resolution", "initial_timestamp", "length").distinct().limit(2).count() > 1:
            raise InvalidParameter("the series do not share one grid")
    elif types == {IRREGULAR}:
        if associations.select("timestamps_hash").distinct().limit(2).count() > 1:
            raise InvalidParameter("the series do not share one timestamp vector")
    else:
        raise InvalidParameter("a static reader needs series of one static type")


def static_reader(associations: DataFrame, arrays: DataFrame, f: ListFilter = ListFilter(), time_series_type: int = SINGLE) -> DataFrame:
    """(catalog columns, values) of the static series of f that share one grid or one timestamp vector; anything else is refused."""
    chosen = f.of(associations).where(F.col("time_series_type") == time_series_type)
    check_static(chosen)
    return chosen.join(arrays.select("data_hash", "values"), "data_hash")


FORECAST_TIMELINE = ["initial_timestamp", "resolution", "interval", "count"]


def check_forecasts(associations: DataFrame) -> dict:
    """Forecasts of one type (dense and derived are one) with one resolution and one timeline of windows: that timeline."""
    kinds = {DERIVED: DETERMINISTIC}
    types = {kinds.get(r[0], r[0]) for r in associations.select("time_series_type").distinct().collect()}
    if len(types) != 1 or types & {SINGLE, IRREGULAR}:
        raise InvalidParameter("a forecast reader needs forecasts of one type")
    lines = associations.select(*FORECAST_TIMELINE).distinct().limit(2).collect()
    if len(lines) > 1:
        raise InvalidParameter("the forecasts do not share one timeline of windows")
    return lines[0].asDict()


def forecast_reader(associations: DataFrame, arrays: DataFrame, f: ListFilter, keep: list[str], at: dt.datetime | None = None) -> DataFrame:
    """(keep, w, h, v, issue_time, target_time) of the forecasts of f, dense and derived side by side, for one window or all."""
    chosen = f.of(associations).where(F.col("time_series_type") > IRREGULAR)
    line = check_forecasts(chosen)
    resolution, interval = Period.parse(line["resolution"]), Period.parse(line["interval"])
    # one window's steps differ by horizon; each horizon is a plan of its own
    horizons = sorted((r[0], r[1]) for r in chosen.select("horizon", "time_series_type").distinct().collect())
    k = window_index(line["initial_timestamp"], interval, line["count"], at) if at is not None else None
    windows = (k, k + 1) if k is not None else None
    out = None
    for horizon, kind in horizons:
        rows = chosen.where(
            (F.col("horizon") == horizon) & (F.col("time_series_type") == kind),
        ).join(arrays.select("data_hash", "values"), "data_hash")
        if kind == DERIVED:
            part = derived_windows(rows, keep, Period.parse(horizon), interval, resolution, windows=windows).withColumn("p", F.lit(0).cast("long"))
        else:
            part = dense_windows(rows, keep, resolution.divide_into(Period.parse(horizon)), resolution, interval, windows=windows)
        part = part.select(*keep, "p", "w", "h", "v", "issue_time", "target_time")
        out = part if out is None else out.union(part)
    return out


def static_sweep(rows: DataFrame, resolution: Period, keep: list[str]) -> DataFrame:
    """(t, *keep, v) of all series for all timestamps."""
    return steps(rows, resolution, keep).select("t", *keep, "v")


def static_read(rows: DataFrame, initial: dt.datetime, resolution: Period, at: dt.datetime, keep: list[str]) -> DataFrame:
    """The values at one timestamp, which must be on the grid: one element of each array, no explode."""
    i = resolution.steps_between(initial, at)
    return rows.where(F.col("length") > i).select(*keep, F.element_at("values", i + 1).alias("v"))


def window_index(initial: dt.datetime, interval: Period, count: int, at: dt.datetime) -> int:
    if interval.zero:
        if at != initial:
            raise InvalidParameter("a zero interval has one window")
        return 0
    k = interval.steps_between(initial, at)
    if k >= count:
        raise InvalidParameter("past the last window")
    return k


def slots(associations: DataFrame) -> DataFrame:
    """One physical read for entries that share array, plan and element type."""
    return associations.select("data_hash", "element_type", "time_series_type", "horizon", "interval", "count").distinct()


def grid(sweep: DataFrame, label: str, labels: list[str], by: list[str] | None = None) -> DataFrame:
    """Timestamps (of each of by) by series: one column for each label."""
    return sweep.groupBy(*(by or []), "t").pivot(label, labels).agg(F.first("v"))
