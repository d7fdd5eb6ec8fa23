"""Reads of many series over one time range, whatever their types and resolutions, as one plan.

Resolutions and intervals are columns, so hourly, monthly and irregular series and forecasts are cut side by side:
no series is read apart, no step is exploded, and no resolution is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameter, NotFound
from ..functions.parse import DERIVED, DETERMINISTIC, IRREGULAR, SINGLE
from ..functions.period_columns import Periods

def long(n: int) -> Column:
    return F.lit(n).cast("long")


def up_to(n: Column) -> Column:
    """0 .. n - 1; nothing for n of 0 or less."""
    return F.filter(F.sequence(long(0), F.greatest(n.cast("long"), long(1)) - 1), lambda i: i < n)


def windows_of_single(values: Column, steps: Column, first: Column, count: Column, stride: Column, width: Column) -> Column:
    """The dense array [steps, count, width] of windows first, first + 1, ... of a single series.

    Window c begins at step c * stride; each step of each window is a slice of width values.
    """
    row = lambda h: F.flatten(
        F.transform(
            up_to(count), lambda c: F.slice(values, (((first + c) * stride + h) * width + 1).cast("int"), width.cast("int"))
        )
    )
    cut = F.flatten(F.transform(up_to(steps), row))
    # where no window reaches past the array, a step of one value is taken as it is, without a slice of its own
    inside = (width == 1) & (steps > 0) & (count > 0) & (((first + count - 1) * stride + steps) <= F.size(values))
    places = F.sequence(long(0), F.greatest(steps * count, long(1)) - 1)
    single = F.transform(places, lambda p: F.get(values, ((first + p % count) * stride + F.floor(p / count)).cast("int")))
    return F.when(inside, single).otherwise(cut)


def windows_of_dense(values: Column, count: Column, first: Column, chosen: Column, width: Column) -> Column:
    """Of a dense array [leading, count, width] the windows first .. first + chosen - 1, in the same order."""
    leading = F.when(count * width > 0, F.size(values) / (count * width)).otherwise(0)
    cut = lambda i: F.slice(values, ((i * count + first) * width + 1).cast("int"), (chosen * width).cast("int"))
    return F.flatten(F.transform(up_to(leading), cut))


def axis_slice(arrays: DataFrame, first: int, end: int) -> DataFrame:
    """arrays (shape, values, ...) cut to the places [first, end) of their first axis, as far as they have them."""
    if first < 0 or end < first:
        raise InvalidParameter(f"not a slice: {first} to {end}")
    n = F.element_at("shape", 1).cast("long")
    width = F.aggregate(F.slice("shape", 2, 1 << 30), long(1), lambda a, x: a * x)
    lo, hi = F.least(long(first), n), F.least(long(end), n)
    values = F.slice("values", (lo * width + 1).cast("int"), ((hi - lo) * width).cast("int"))
    shape = F.concat(F.array((hi - lo).cast("int")), F.slice("shape", 2, 1 << 30))
    return arrays.where(F.size("shape") > 0).withColumns({"values": values, "__shape": shape}).drop("shape").withColumnRenamed("__shape", "shape")


def step_shape() -> Column:
    """The axes of one step: those of element_shape after the axes that a forecast has besides its first."""
    held = F.coalesce("element_shape", F.expr("cast(array() as array<int>)"))
    extra = F.when(F.col("time_series_type") == DETERMINISTIC, 1).when(F.col("time_series_type") > DERIVED, 2).otherwise(0)
    return F.slice(held, extra + 1, F.greatest(F.size(held) - extra, F.lit(0)))


def step_width() -> Column:
    """How many values one step has."""
    return F.aggregate(step_shape(), long(1), lambda a, x: a * x)


#: Columns of planned(): first step or window, one past the last, steps of a window, steps between windows, values of a step,
#: windows that are stored, the new first instant, and what is wrong.
PLANNED = ("__lo", "__hi", "__steps", "__stride", "__width", "__windows", "__first", "__problem")


def _parsed(rows: DataFrame) -> DataFrame:
    """rows with the kind and number of resolution, horizon and interval."""
    added = {}
    for name in ("resolution", "horizon", "interval"):
        period = Periods.of(F.col(name))
        added |= {f"__{name}_kind": period.kind, f"__{name}_n": period.n}
    return rows.withColumns(added)


def _period(name: str) -> Periods:
    return Periods(F.col(f"__{name}_kind"), F.col(f"__{name}_n"))


def _problem(start: Column, end: Column) -> Column:
    """What is wrong with reading a row over the range, or null."""
    forecast = F.col("time_series_type") > IRREGULAR
    several = F.col("__interval_n") > 0
    rules = [
        (end < start, "end < start"),
        (F.col("time_series_type").isNull(), "no such series"),
        ((F.col("time_series_type") != IRREGULAR) & F.col("__resolution_n").isNull(), "a resolution that is no period"),
        (forecast & ~several & ~((F.col("count") == 1) & (F.col("__interval_n") == 0)), "the interval must be positive"),
        (forecast & ~several & (F.col("initial_timestamp") != start), "start is not a window boundary"),
        (forecast & several & F.col("__w").isNull(), "start is not a window boundary"),
        (forecast & several & (F.col("__w") >= F.col("count")), "start is past the last window"),
    ]
    return F.coalesce(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(text)) for rule, text in rules])


def planned(rows: DataFrame, timestamp_sets: DataFrame, start: Column, end: Column) -> DataFrame:
    """rows (catalog columns) with timestamps and PLANNED: what of each array is to be read. Arrays are not touched."""
    rows = _parsed(rows).join(timestamp_sets.select("timestamps_hash", "timestamps"), "timestamps_hash", "left")
    resolution, interval = _period("resolution"), _period("interval")
    kind, initial, length = F.col("time_series_type"), F.col("initial_timestamp"), F.col("length").cast("long")
    forecast = kind > IRREGULAR
    before = lambda at: F.size(F.filter("timestamps", lambda t: t < at)).cast("long")
    lo = F.when(kind == IRREGULAR, before(start)).when(kind == SINGLE, F.least(resolution.floor(initial, start), length))
    hi = F.when(kind == IRREGULAR, before(end)).when(kind == SINGLE, F.least(resolution.ceil(initial, end), length))
    last = F.when(interval.n > 0, F.least(F.col("count").cast("long"), interval.ceil(initial, end)))
    rows = rows.withColumn("__w", F.when(forecast, interval.steps(initial, start)))
    rows = rows.withColumns(
        {
            "__lo": F.coalesce(lo, F.col("__w"), long(0)),
            "__hi": F.coalesce(hi, last, (initial < end).cast("long")),
            "__steps": F.when(forecast, resolution.divide_into(_period("horizon"))),
            "__stride": F.when(kind == DERIVED, F.coalesce(resolution.divide_into(interval), long(0))),
            "__width": step_width(),
            "__windows": F.col("count").cast("long"),
            "__problem": _problem(start, end),
        }
    )
    began = F.when(kind == SINGLE, resolution.add(initial, F.col("__lo"))).when(forecast & (interval.n > 0), interval.add(initial, F.col("__lo")))
    rows = rows.withColumn("__first", F.coalesce(began, initial))
    return rows.drop("__w", *[c for c in rows.columns if c.endswith(("_kind", "_n")) and c.startswith("__")])


def check_ranges(plan: DataFrame) -> None:
    """An error if a row of planned() cannot be read over its range."""
    found = plan.where("__problem is not null").limit(1).collect()
    if found:
        row = found[0]
        kind = NotFound if row["__problem"] == "no such series" else InvalidParameter
        raise kind(f"{row['owner_id']}/{row['name']}: {row['__problem']}")


def cut(rows: DataFrame) -> DataFrame:
    """rows of planned() with values, cut.

    Single series: the steps whose span overlaps the range. Irregular ones: the steps in it. Forecasts: the windows that
    begin in it, views as the dense array that they show. Columns initial_timestamp, length, count, values and timestamps are
    those of what is left; shape is its shape without the axes of one step.
    """
    kind, lo, width, steps = F.col("time_series_type"), F.col("__lo"), F.col("__width"), F.col("__steps")
    # a name of its own, as the result has another column count
    forecast, count = kind > IRREGULAR, F.col("__windows")
    n = F.greatest(F.col("__hi") - lo, long(0))
    static = F.slice("values", (lo * width + 1).cast("int"), (n * width).cast("int"))
    view = windows_of_single(F.col("values"), steps, lo, n, F.col("__stride"), width)
    dense = windows_of_dense(F.col("values"), count, lo, n, width)
    leading = F.when(count * width * steps > 0, F.size("values") / (count * width * steps)).cast("long")
    shape = F.when(~forecast, F.array(n)).when(kind.isin(DETERMINISTIC, DERIVED), F.array(steps, n)).otherwise(F.array(leading, steps, n))
    out = rows.withColumns(
        {
            "values": F.when(kind == DERIVED, view).when(forecast, dense).otherwise(static),
            "shape": shape,
            "initial_timestamp": F.col("__first"),
            "timestamps": F.slice("timestamps", (lo + 1).cast("int"), n.cast("int")),
            "length": F.when(forecast, steps).otherwise(n),
            "count": F.when(forecast, n),
        }
    )
    return out.drop(*PLANNED)


def read_ranges(
    keys: DataFrame,
    on: list[str],
    associations: DataFrame,
    arrays: DataFrame,
    timestamp_sets: DataFrame,
    start: Column,
    end: Column,
) -> DataFrame:
    """The series of keys (ordinal, *on) over [start, end), one row a key; a key that no series has is an error.

    Arrays meet the planned rows of the keys alone, and only their values are read.
    """
    plan = planned(keys.join(associations, on, "left"), timestamp_sets, start, end)
    check_ranges(plan)
    return cut(plan.join(arrays.select("data_hash", "dtype", "values"), "data_hash"))
