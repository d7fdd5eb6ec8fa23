"""Reads at one instant by slots: what several series share is read, cut and decoded once, then fanned out.

A slot is an array with a way of reading it. Series that share array, type, grid and horizon share the slot, so the
arrays table is joined with slots, not with series, and a join back gives each series its values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import DERIVED, IRREGULAR
from ..functions.period_columns import Periods
from .ranges import long, step_width, up_to

#: What two series must share to share a slot.
SLOT = (
    "data_hash", "time_series_type", "initial_timestamp", "resolution", "length", "horizon", "interval", "count",
    "timestamps_hash", "element_type", "element_shape",
)


def slotted(associations: DataFrame) -> DataFrame:
    """associations with column slot."""
    return associations.withColumn("slot", F.struct(*SLOT))


def slots_of(entries: DataFrame) -> DataFrame:
    """One row a slot (columns slot and SLOT) of slotted() rows."""
    return entries.select("slot").distinct().select("slot", "slot.*")


def _place(timestamp_sets: DataFrame, slots: DataFrame, at: Column) -> DataFrame:
    """slots with __k: the step of a static series, or the window of a forecast, that stands at the instant; null for none."""
    resolution, interval = Periods.of(F.col("resolution")), Periods.of(F.col("interval"))
    rows = slots.withColumns({"__rk": resolution.kind, "__rn": resolution.n, "__ik": interval.kind, "__in": interval.n})
    horizon = Periods.of(F.col("horizon"))
    rows = rows.withColumns({"__hk": horizon.kind, "__hn": horizon.n})
    rows = rows.join(timestamp_sets.select("timestamps_hash", "timestamps"), "timestamps_hash", "left")
    resolution, interval, horizon = (Periods(F.col(f"__{p}k"), F.col(f"__{p}n")) for p in "rih")
    kind, initial = F.col("time_series_type"), F.col("initial_timestamp")
    step = F.when(kind == IRREGULAR, F.array_position("timestamps", at) - 1).otherwise(resolution.steps(initial, at))
    window = F.when(interval.n == 0, F.when(initial == at, long(0))).otherwise(interval.steps(initial, at))
    k = F.when(kind <= IRREGULAR, step).otherwise(window)
    n = F.when(kind <= IRREGULAR, F.col("length")).otherwise(F.col("count"))
    rows = rows.withColumn("__k", k).where((F.col("__k") >= 0) & (F.col("__k") < n))
    stride = F.coalesce(resolution.divide_into(interval), long(0))
    rows = rows.withColumns({"__steps": resolution.divide_into(horizon), "__stride": stride, "__width": step_width()})
    return rows.withColumn("__windows", F.col("count").cast("long"))


def read_slots(slots: DataFrame, arrays: DataFrame, timestamp_sets: DataFrame, at: Column) -> DataFrame:
    """(slot, values) of slots_of() rows: the step, or the whole window, that stands at the instant.

    Slots that have nothing there are left out. A window's values are in the order [leading, steps, width].
    """
    rows = _place(timestamp_sets, slots, at).join(arrays.select("data_hash", F.col("values").alias("__all")), "data_hash")
    k, width, steps, count = (F.col(f"__{c}") for c in ("k", "width", "steps", "windows"))
    static = F.slice("__all", (k * width + 1).cast("int"), width.cast("int"))
    view = F.slice("__all", (k * F.col("__stride") * width + 1).cast("int"), (steps * width).cast("int"))
    rows_of_dense = F.when(count > 0, F.size("__all") / (count * width)).otherwise(0)
    cut = lambda i: F.slice("__all", ((i * count + k) * width + 1).cast("int"), width.cast("int"))
    dense = F.flatten(F.transform(up_to(rows_of_dense), cut))
    kind = F.col("time_series_type")
    return rows.select("slot", F.when(kind <= IRREGULAR, static).when(kind == DERIVED, view).otherwise(dense).alias("values"))


def read_at(associations: DataFrame, arrays: DataFrame, timestamp_sets: DataFrame, at: Column, keep: list[str]) -> DataFrame:
    """(*keep, values) of all series that have something at the instant; each slot is read once."""
    entries = slotted(associations)
    return entries.select(*keep, "slot").join(read_slots(slots_of(entries), arrays, timestamp_sets, at), "slot").select(*keep, "values")
