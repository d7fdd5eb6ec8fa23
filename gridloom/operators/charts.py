"""Data behind charts. What concerns one series is worked out on its array, in its row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.period import Period
from .catalog import finite_values


def duration_curve(rows: DataFrame, by: list[str], values: str = "values") -> DataFrame:
    """Finite values from the largest down, each with the percentage of values that precede it."""
    out = rows.select(*by, F.sort_array(finite_values(values), asc=False).alias("__s"))
    out = out.select(*by, F.size("__s").alias("__n"), F.posexplode("__s").alias("__i", "v"))
    return out.select(*by, (F.col("__i") + 1).cast("long").alias("rank"), (F.col("__i") / F.col("__n") * 100).alias("percent"), "v")


def heatmap(rows: DataFrame, by: list[str], resolution: Period, values: str = "values") -> DataFrame:
    """Row of the day and day number of each finite value; the step must divide a day."""
    day = 86_400_000
    if resolution.kind != "fixed" or resolution.n <= 0 or day % resolution.n:
        raise ValueError("the resolution must divide a day")
    first = F.date_trunc("day", "initial_timestamp").cast("timestamp_ntz")
    out = rows.select(
        *by,
        resolution.floor(first, F.col("initial_timestamp")).alias("__k"),
        F.posexplode(F.transform(values, lambda x: x.cast("double"))).alias("__i", "v"),
    )
    place = F.col("__k") + F.col("__i")
    each = day // resolution.n
    return out.where(~F.isnan("v") & (F.abs("v") < float("inf"))).select(
        *by,
        (place % each).cast("long").alias("row"),
        F.floor(place / each).cast("long").alias("col"),
        "v",
    )


def sparkline(rows: DataFrame, by: list[str], width: int, values: str = "values") -> DataFrame:
    """Of each of width buckets the value furthest from the mean, the last of equals."""
    finite = finite_values(values)
    out = rows.select(
        *by,
        F.transform(values, lambda x: x.cast("double")).alias("__v"),
        F.try_divide(F.aggregate(finite, F.lit(0.0), lambda a, x: a + x), F.size(finite)).alias("__m"),
    )
    out = out.where(F.size("__v") > 0).withColumn("__b", F.least(F.lit(width), F.size("__v")))
    # bucket b has the places from b * n div buckets up to before (b + 1) * n div buckets
    cut = lambda b: F.floor(b * F.size("__v") / F.col("__b"))
    far = lambda i: F.struct(F.abs(F.get("__v", i) - F.col("__m")).alias("d"), i.alias("i"), F.get("__v", i).alias("v"))
    usable = lambda x: ~F.isnan(x["v"]) & (F.abs(x["v"]) < float("inf"))
    best = lambda b: F.array_max(F.filter(F.transform(F.sequence(cut(b).cast("int"), (cut(b + 1) - 1).cast("int")), far), usable))["v"]
    out = out.select(*by, F.posexplode(F.transform(F.sequence(F.lit(0), F.col("__b") - 1), best)).alias("bucket", "v"))
    return out.where(F.col("v").isNotNull()).select(*by, F.col("bucket").cast("long").alias("bucket"), "v")


def fan(rows: DataFrame, n: int) -> DataFrame:
    """Bands of percentiles p and n - 1 - p of each target time, the outermost first; an odd middle stands alone."""
    low = rows.where(F.col("p") <= (n - 1) // 2).select("target_time", F.col("p").alias("band"), F.col("v").alias("low"))
    high = rows.where(F.col("p") >= n // 2).select("target_time", (F.lit(n - 1) - F.col("p")).alias("band"), F.col("v").alias("high"))
    return low.join(high, ["target_time", "band"])


def overlay(windows: DataFrame, actual: DataFrame, on: list[str]) -> DataFrame:
    """Forecast steps beside the values that came true (actual: on, target_time, actual)."""
    return windows.join(actual, [*on, "target_time"])


def traces(rows: DataFrame, label: str = "scenario ") -> DataFrame:
    """(target_time, trace, v) of the windows of scenarios: one trace each, numbered from 1."""
    return rows.select("target_time", F.concat(F.lit(label), (F.col("p") + 1).cast("string")).alias("trace"), "v")


def _beside(views: DataFrame, by: list[str], resolution: Period, horizon: Period, interval: Period, shift: int) -> DataFrame:
    """(by, w, issue_time, pairs): each window of a view beside the steps of its own series that lie shift steps later."""
    steps, stride = resolution.divide_into(horizon), resolution.divide_into(interval)
    rows = views.select(*by, "initial_timestamp", "values", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("w"))
    at = lambda more: F.slice("values", (F.col("w") * stride + 1 + more).cast("int"), F.lit(steps))
    pairs = F.arrays_zip(at(0).alias("v"), at(shift).alias("actual"))
    return rows.select(*by, "w", interval.add(F.col("initial_timestamp"), F.col("w")).alias("issue_time"), pairs.alias("pairs"))


def overlaid(views: DataFrame, by: list[str], resolution: Period, horizon: Period, interval: Period, shift: int) -> DataFrame:
    """(by, w, h, target_time, v, actual): what a view said shift steps before, beside what came true.

    Both stand in the array of one row: no join, and no step is shuffled. Steps that the series does not have yet are left out.
    """
    rows = _beside(views, by, resolution, horizon, interval, shift).select(*by, "w", "issue_time", F.posexplode("pairs").alias("__h", "__x"))
    target = resolution.add(F.col("issue_time"), F.col("__h").cast("long") + shift)
    out = rows.where(F.col("__x.actual").isNotNull())
    return out.select(
        *by,
        "w",
        F.col("__h").cast("long").alias("h"),
        target.alias("target_time"),
        F.col("__x.v").alias("v"),
        F.col("__x.actual").alias("actual"),
    )


def forecast_error(views: DataFrame, by: list[str], resolution: Period, horizon: Period, interval: Period, shift: int) -> DataFrame:
    """(by, error): the sum of all differences of overlaid(), worked out window by window."""
    both = F.filter("pairs", lambda x: x["actual"].isNotNull())
    error = F.aggregate(both, F.lit(0).cast("long"), lambda a, x: a + (x["v"] - x["actual"]).cast("long"))
    rows = _beside(views, by, resolution, horizon, interval, shift).select(*by, error.alias("e"))
    return rows.groupBy(*by).agg(F.sum("e").alias("error"))
