"""Series of any type from a CSV file and a description.

The shape comes from the description where that states it, and from the file's rows and columns where it does not: the
steps of a static series, the number of scenarios. What does not fit is an error, found in one aggregation over the file.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..functions.elements import ElementType
from ..functions.parse import DERIVED, DETERMINISTIC, IRREGULAR, PROBABILISTIC, SCENARIOS, SINGLE, series_type, timestamp
from ..functions.period import Period, instant
from . import csv_io

KEYS = frozenset(
    "owner_id owner_type owner_category time_series_type name initial_timestamp resolution horizon interval count percentiles "
    "scenario_count length element_type element_shape units".split()
)


@dataclass
class Description:
    """What the file does not say."""

    time_series_type: int
    name: str
    element_type: ElementType
    element_shape: list[int]
    given: dict = field(default_factory=dict)

    @staticmethod
    def of(items: dict) -> Description:
        if unknown := set(items) - KEYS:
            raise InvalidParameter(f"unknown keys: {', '.join(sorted(unknown))}")
        kind = items.get("time_series_type", SINGLE)
        kind = kind if isinstance(kind, int) else series_type(kind)
        if kind == DERIVED:
            raise InvalidParameter("a view is not added from a file: add the single series and transform it")
        element, shape = ElementType.parse(items.get("element_type", "f64")), list(items.get("element_shape", []))
        if any(n < 1 for n in shape):
            raise InvalidParameter("element_shape must not contain a zero dimension")
        element.check_shape(element.dtype, shape)
        return Description(kind, items.get("name", ""), element, shape, items)

    def need(self, name: str):
        if self.given.get(name) is None:
            raise InvalidParameter(f"series {self.name!r} needs {name}")
        return self.given[name]

    def period(self, name: str) -> Period:
        return Period.parse(self.need(name))

    @property
    def initial(self):
        at = self.need("initial_timestamp")
        return timestamp(at) if isinstance(at, str) else at

    @property
    def width(self) -> int:
        return prod(self.element_shape)

    @property
    def steps(self) -> int:
        """Steps of a window."""
        return self.period("resolution").divide_into(self.period("horizon"))


def _leading(d: Description, found: int | None) -> list[int]:
    """The axis before the steps: percentiles or scenarios, given or found in the file."""
    if d.time_series_type == DETERMINISTIC:
        leading = None
    elif d.time_series_type == PROBABILISTIC:
        leading = len(d.need("percentiles"))
        if leading > 1 and any(a >= b for a, b in zip(d.given["percentiles"], d.given["percentiles"][1:], strict=False)):
            raise InvalidParameter("percentiles must increase")
    else:
        leading = d.given.get("scenario_count") or found
        if not leading:
            raise InvalidParameter("scenario_count cannot be inferred: the values are no multiple of steps, windows and elements")
    if found is not None and (leading or 1) != found:
        raise InvalidParameter(f"the file holds {found} values side by side, not {leading or 1}")
    return [] if leading is None else [leading]


def _forecast(spark: SparkSession, path: str, d: Description, layout: str) -> tuple[DataFrame, list[int]]:
    """(values) and the shape of a forecast."""
    resolution, interval, count = d.period("resolution"), d.period("interval"), int(d.need("count"))
    if not interval.positive and count > 1:
        raise InvalidParameter("a zero interval has one window")
    unit = d.steps * count * d.width
    if layout == "values":
        rows = csv_io.read_values(spark, path)
        total = rows.select(F.size("values")).first()[0]
        found = total // unit if unit and total % unit == 0 else None
        if found is None and d.time_series_type != SCENARIOS:
            raise InvalidParameter(f"{total} values do not fit {d.steps} steps of {count} windows")
        leading = _leading(d, found)
        return rows, [*leading, d.steps, count, *d.element_shape]
    if layout != "forecast":
        raise InvalidParameter("a forecast needs issue_time and target_time, or values alone")
    rows = csv_io.read_forecast(spark, path)
    zero = F.when(F.col("issue_time") == instant(d.initial), F.lit(0).cast("long"))
    w = interval.steps(instant(d.initial), F.col("issue_time")) if interval.positive else zero
    rows = rows.withColumn("w", w).withColumn("h", resolution.steps(F.col("issue_time"), F.col("target_time")))
    inside = (F.col("w") < count) & (F.col("h") < d.steps)
    facts = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.coalesce(inside, F.lit(False))).alias("off"),
        F.countDistinct("w", "h").alias("places"),
        F.min(F.size("v")).alias("narrow"),
        F.max(F.size("v")).alias("wide"),
    ).first()
    if facts["off"]:
        raise InvalidParameter(f"{facts['off']} rows are off the grid of windows and steps")
    if facts["rows"] != d.steps * count or facts["places"] != facts["rows"]:
        raise InvalidParameter(f"{facts['rows']} rows for {facts['places']} places of {d.steps * count}")
    if facts["narrow"] != facts["wide"] or facts["wide"] % d.width:
        raise InvalidParameter("the rows do not all hold whole elements")
    leading = _leading(d, facts["wide"] // d.width)
    return csv_io.forecast_values(rows, d.steps, count, (leading or [1])[0], d.width), [*leading, d.steps, count, *d.element_shape]


def _static(spark: SparkSession, path: str, d: Description, layout: str) -> tuple[DataFrame, list[int]]:
    """(values, timestamps) and the shape of a single or irregular series."""
    irregular = d.time_series_type == IRREGULAR
    if layout == "forecast" or (irregular and layout != "timestamped"):
        raise InvalidParameter("an irregular series needs timestamps" if irregular else "a forecast file is not a single series")
    if layout == "timestamped":
        rows = csv_io.read_timestamped(spark, path)
        held = rows.agg(F.array_sort(F.collect_list(F.struct("row", "t", "v"))).alias("p"))
        held = held.select(F.flatten("p.v").alias("values"), F.col("p.t").alias("timestamps"))
    else:
        held = csv_io.read_values(spark, path).withColumn("timestamps", F.lit(None).cast("array<timestamp_ntz>"))
    later = F.arrays_zip(F.slice("timestamps", F.lit(1), F.greatest(F.size("timestamps") - 1, F.lit(0))), F.slice("timestamps", 2, 1 << 30))
    facts = held.select(F.size("values").alias("n"), F.exists(later, lambda x: x["0"] >= x["1"]).alias("late")).first()
    if facts["n"] % d.width:
        raise InvalidParameter(f"{facts['n']} values are no multiple of {d.width} a step")
    length = facts["n"] // d.width
    if d.given.get("length") not in (None, length):
        raise InvalidParameter(f"{length} steps, not {d.given['length']}")
    if irregular and facts["late"]:
        raise InvalidParameter("timestamps must increase")
    if not irregular:
        resolution, initial = d.period("resolution"), d.initial
        if layout == "timestamped":
            csv_io.check_grid(rows, initial, resolution, length)
        held = held.withColumn("timestamps", F.lit(None).cast("array<timestamp_ntz>"))
    return held, [length, *d.element_shape]


def typed_series(spark: SparkSession, path: str, description: dict) -> DataFrame:
    """One row: the description's fields, shape and values (row-major), and the timestamps of an irregular series."""
    d = Description.of(description)
    layout = csv_io.layout(csv_io.header(spark, path))
    if d.time_series_type > IRREGULAR:
        rows, shape = _forecast(spark, path, d, layout)
        rows = rows.withColumn("timestamps", F.lit(None).cast("array<timestamp_ntz>"))
    else:
        rows, shape = _static(spark, path, d, layout)
    text = {k: d.period(k).iso() for k in ("resolution", "horizon", "interval") if d.given.get(k) is not None}
    plain = {k: d.given.get(k) for k in ("owner_id", "owner_type", "owner_category", "name", "count", "units")} | text
    types = {"owner_id": "long", "count": "long"}
    columns = [
        F.lit(plain.get(k)).cast(types.get(k, "string")).alias(k) for k in [
            *plain,
            *[k for k in ("resolution", "horizon", "interval") if k not in plain],
        ]
    ]
    initial = F.lit(None).cast("timestamp_ntz") if d.given.get("initial_timestamp") is None else instant(d.initial)
    return rows.select(
        F.lit(d.time_series_type).alias("time_series_type"),
        *columns,
        initial.alias("initial_timestamp"),
        F.lit(str(d.element_type)).alias("element_type"),
        F.array(*map(F.lit, shape)).cast("array<int>").alias("shape"),
        F.lit(d.given.get("percentiles")).cast("array<double>").alias("percentiles"),
        "timestamps",
        "values",
    )
