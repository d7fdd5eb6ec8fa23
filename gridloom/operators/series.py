"""Reading series: slices by time, forecast windows, views derived from single series, transform."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..functions.parse import DERIVED, DETERMINISTIC, SINGLE
from ..functions.period import Period, instant


def slice_regular(rows: DataFrame, resolution: Period, start: dt.datetime, end: dt.datetime, width: int = 1) -> DataFrame:
    """Steps whose span overlaps [start, end): start is floored, end ceiled onto the grid, both clamped.

    rows: initial_timestamp, length and values; all of one resolution. The new initial may lie before start.
    """
    if end < start:
        raise InvalidParameter("end < start")
    length = F.col("length").cast("long")
    i0 = F.least(resolution.floor(F.col("initial_timestamp"), instant(start)), length)
    i1 = F.greatest(F.least(resolution.ceil(F.col("initial_timestamp"), instant(end)), length), i0)
    cut = F.slice("values", (i0 * width + 1).cast("int"), ((i1 - i0) * width).cast("int"))
    new = resolution.add(F.col("initial_timestamp"), i0)
    return rows.withColumns({"values": cut, "length": (i1 - i0).cast("long"), "initial_timestamp": new})


def slice_irregular(rows: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Steps at t with start <= t < end (values has one value a step)."""
    if end < start:
        raise InvalidParameter("end < start")
    kept = F.filter(F.arrays_zip("timestamps", "values"), lambda x: (x["timestamps"] >= instant(start)) & (x["timestamps"] < instant(end)))
    return rows.withColumn("__kept", kept).withColumns(
        {"timestamps": F.col("__kept.timestamps"), "values": F.col("__kept.values"), "length": F.size("__kept").cast("long")},
    ).drop("__kept")


def steps(rows: DataFrame, resolution: Period, keep: list[str]) -> DataFrame:
    """One row a step: keep, idx, t and v."""
    out = rows.select(*keep, "initial_timestamp", F.posexplode("values").alias("idx", "v"))
    return out.select(
        *keep,
        F.col("idx").cast("long").alias("idx"),
        resolution.add(F.col("initial_timestamp"), F.col("idx").cast("long")).alias("t"),
        "v",
    )


def row_window(rows: DataFrame, index: Column, stride: int = 1, tail: int | None = None, limit: int | None = None) -> DataFrame:
    """Every stride-th row, then the last or the first so many."""
    rows = rows.where(index % stride == 0)
    if tail is not None:
        return rows.orderBy(index.desc()).limit(tail).orderBy(index)
    return rows.orderBy(index).limit(limit) if limit is not None else rows.orderBy(index)


def resolve_windows(
    initial: dt.datetime,
    interval: Period,
    count: int,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
) -> tuple[int, int]:
    """The windows [w0, w1) that begin in [start, end); start must be a window's, and one that exists."""
    if start is None or end is None:
        return 0, count
    if end < start:
        raise InvalidParameter("end < start")
    if not interval.positive:
        if count == 1 and interval.zero:
            if start != initial:
                raise InvalidParameter("start is not a window boundary")
            return 0, int(initial < end)
        raise InvalidParameter("the interval must be positive")
    w0 = interval.steps_between(initial, start)
    if w0 >= count:
        raise InvalidParameter(f"start is past the last window: {w0} of {count}")
    return w0, max(w0, min(count, interval.ceil_steps(initial, end)))


def dense_windows(
    rows: DataFrame,
    keep: list[str],
    steps_: int,
    resolution: Period,
    interval: Period,
    width: int = 1,
    windows: tuple[int, int] | None = None,
) -> DataFrame:
    """A dense forecast [leading, steps, count, width] as rows: p, w, h, e, issue_time, target_time and v.

    leading, the number of percentiles or scenarios, follows from the array's size.
    """
    n = F.col("count").cast("long")
    w0, w1 = (
        F.greatest(F.lit(windows[0]).cast("long"), F.lit(0)),
        F.least(F.lit(windows[1]).cast("long"), n),
    ) if windows else (F.lit(0).cast("long"), n)
    # one slice of the chosen windows for each of leading x steps, so that nothing else is exploded
    wide = F.greatest(w1 - w0, F.lit(0).cast("long"))
    rows = rows.where((n > 0) & (F.size("values") > 0))
    places = lambda v: F.sequence(F.lit(0).cast("long"), F.floor(F.size(v) / (n * width)) - 1)
    slices = lambda v: F.transform(places(v), lambda i: F.slice(v, ((i * n + w0) * width + 1).cast("int"), (wide * width).cast("int")))
    cut = F.element_at(F.transform(F.array("values"), slices), 1)  # the array is evaluated once, however it is made
    out = rows.select(*keep, "initial_timestamp", w0.alias("__w"), F.posexplode(cut).alias("__i", "__cut"))
    out = out.select(*keep, "initial_timestamp", "__w", F.col("__i").cast("long").alias("__i"), F.posexplode("__cut").alias("__j", "v"))
    j = F.col("__j").cast("long")
    at = {"e": j % width, "w": F.col("__w") + F.floor(j / width), "h": F.col("__i") % steps_, "p": F.floor(F.col("__i") / steps_)}
    out = out.withColumns({k: c.cast("long") for k, c in at.items()})
    issue = interval.add(F.col("initial_timestamp"), F.col("w")) if not interval.zero else F.col("initial_timestamp")
    return out.withColumn("issue_time", issue).withColumn(
        "target_time",
        resolution.add(F.col("issue_time"), F.col("h")),
    ).drop("__i", "__j", "__w", "initial_timestamp")


def derived_windows(
    rows: DataFrame,
    keep: list[str],
    horizon: Period,
    interval: Period,
    resolution: Period,
    width: int = 1,
    windows: tuple[int, int] | None = None,
) -> DataFrame:
    """Windows of a view on a single series: window w has the steps from w * (interval / resolution) on.

    Each window's slice is taken before the windows are exploded, so that none carries the whole array.
    """
    h = resolution.divide_into(horizon)
    step = 0 if interval.zero else resolution.divide_into(interval)
    first, end = (
        max(0, windows[0]),
        F.least(F.lit(windows[1]).cast("long"), F.col("count").cast("long")),
    ) if windows else (0, F.col("count").cast("long"))
    rows = rows.where(end > first)
    places = F.sequence(F.lit(first).cast("long"), end - 1)
    cuts = F.transform(places, lambda w: F.slice("values", (w * step * width + 1).cast("int"), F.lit(h * width)))
    out = rows.select(*keep, "initial_timestamp", F.posexplode(cuts).alias("__w", "__cut"))
    out = out.select(*keep, "initial_timestamp", "__cut", (F.col("__w") + first).cast("long").alias("w"))
    issue = F.col("initial_timestamp") if interval.zero else interval.add(F.col("initial_timestamp"), F.col("w"))
    out = out.select(*keep, "w", issue.alias("issue_time"), F.posexplode("__cut").alias("__i", "v"))
    out = out.withColumn("h", F.floor(F.col("__i") / width).cast("long")).withColumn("e", (F.col("__i") % width).cast("long"))
    return out.withColumn("target_time", resolution.add(F.col("issue_time"), F.col("h"))).drop("__i")


def transform_plan(
    grids: list[tuple[str, dt.datetime, int]],
    horizon: Period,
    interval: Period,
    normalize: bool = False,
    uniform: bool = False,
) -> dict[str, tuple[Period, int]]:
    """For each resolution the interval and window count that a transform derives. grids: resolution, initial, length."""
    plan: dict[str, tuple[Period, int]] = {}
    first = None
    for text, initial, length in grids:
        resolution = Period.parse(text)
        h = resolution.divide_into(horizon)
        if h > length:
            raise InvalidParameter(f"horizon {horizon.iso()} ({h} steps) exceeds length {length}")
        own = interval
        if length == h and interval == horizon:
            own = Period("fixed", 0) if normalize else interval
        elif interval.same_kind(horizon) and interval.n > horizon.n:
            raise InvalidParameter("an interval longer than the horizon leaves gaps")
        if own.zero:
            if h != length:
                raise InvalidParameter("a zero interval means one window over the whole series")
            count = 1
        else:
            count = (length - h) // resolution.divide_into(own) + 1
        if uniform and first and (first[0], first[1], first[2]) != (own, count, initial):
            raise InvalidParameter("one transform would give several forecast grids")
        first = first or (own, count, initial)
        plan[text] = (own, count)
    return plan


def transform(
    associations: DataFrame,
    horizon: Period,
    interval: Period,
    category: str | None = None,
    resolution: str | None = None,
    normalize: bool = False,
    uniform: bool = False,
) -> DataFrame:
    """The new view rows over all single series: catalog rows only, no array is touched.

    Views that exist with this horizon are skipped; one with another horizon is an error, as is a dense
    forecast of the same family.
    """
    from .catalog import static_grids

    # one row a resolution reaches the driver, however many grids there are
    each = static_grids(associations, resolution, category).groupBy("resolution")
    grids = each.agg(F.min("initial_timestamp").alias("initial"), F.min("length").alias("length"), F.count(F.lit(1)).alias("n")).collect()
    if any(g["n"] > 1 for g in grids):
        raise InvalidParameter("series of one resolution have several grids")
    ordered = sorted((g["resolution"], g["initial"], g["length"]) for g in grids)
    plan = transform_plan(ordered, horizon, interval, normalize, uniform)
    spark = associations.sparkSession
    rows = [(r, horizon.iso(), p.iso(), n) for r, (p, n) in plan.items()]
    plans = spark.createDataFrame(rows, "resolution string, __horizon string, __interval string, __count long")
    sources = associations.where(F.col("time_series_type") == SINGLE)
    if category is not None:
        sources = sources.where(F.col("owner_category") == category)
    new = sources.join(F.broadcast(plans), "resolution").withColumns(
        {"time_series_type": F.lit(DERIVED), "horizon": F.col("__horizon"), "interval": F.col("__interval"), "count": F.col("__count")},
    ).drop("__horizon", "__interval", "__count")
    family = ["owner_id", "owner_category", "name", "resolution", "features_hash"]
    dense = associations.where(F.col("time_series_type") == DETERMINISTIC)
    if new.join(dense, family, "left_semi").limit(1).count():
        raise InvalidParameter("a dense forecast of the same family exists")
    old = associations.where(F.col("time_series_type") == DERIVED).select(*family, "interval", F.col("horizon").alias("__old"))
    found = new.join(old, [*family, "interval"], "left")
    if found.where(F.col("__old").isNotNull() & (F.col("__old") != F.col("horizon"))).limit(1).count():
        raise InvalidParameter("a view with another horizon exists")
    return found.where(F.col("__old").isNull()).select(*associations.columns)
