"""Every broken rule of every catalog row and array, as a table: nothing stops at the first fault.

The rules of a row are columns of one projection; the names of those that fail are exploded. Rules across tables (arrays
and vectors that are missing, arrays whose content has another hash) are joins on distinct hashes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.elements import FUNCTIONS
from ..functions.hashing import DTYPES, content_hash
from ..functions.parse import DERIVED, IRREGULAR, PROBABILISTIC, SCENARIOS, SINGLE
from ..functions.period_columns import Periods

HASH = r"^[0-9a-f]{64}$"
CATEGORIES = ("Component", "SupplementalAttribute")


def element_type_known(column: Column) -> Column:
    """Whether a text names an element type: a dtype, a tuple of one, or a function."""
    dtypes = "|".join(DTYPES)
    functions = "|".join(f.replace("_", "_?") for f in FUNCTIONS)
    return F.lower(F.trim(column)).rlike(rf"^(?:{dtypes}|tuple\(0*[1-9][0-9]*,\s*(?:{dtypes})\)|{functions})$")


def rules() -> dict[str, Column]:
    """What must not be, by name; of catalog rows with the periods' numbers beside them."""
    kind = F.col("time_series_type")
    forecast = kind > IRREGULAR
    positive = lambda c: F.col(c).isNotNull() & ~F.coalesce(F.col(f"__{c}") > 0, F.lit(False))
    return {
        "type is unknown": kind.isNull() | ~kind.between(SINGLE, SCENARIOS),
        "data_hash is no hash": F.col("data_hash").isNull() | ~F.col("data_hash").rlike(HASH),
        "element_type is invalid": F.col("element_type").isNull() | ~element_type_known(F.col("element_type")),
        "owner_category is unknown": F.col("owner_category").isNull() | ~F.col("owner_category").isin(*CATEGORIES),
        "owner or name is missing": F.col("owner_id").isNull() | F.col("name").isNull(),
        "resolution is no positive period": positive("resolution"),
        "horizon is no positive period": positive("horizon"),
        "interval is no period": F.col("interval").isNotNull() & ~F.coalesce(F.col("__interval") >= 0, F.lit(False)),
        "resolution or initial_timestamp is missing": (kind != IRREGULAR) & (F.col("resolution").isNull() | F.col("initial_timestamp").isNull()),
        "timestamps are missing": (kind == IRREGULAR) & F.col("timestamps_hash").isNull(),
        "horizon, interval or count is missing": forecast & (F.col("horizon").isNull() | F.col("interval").isNull() | F.col("count").isNull()),
        "percentiles are missing": (kind == PROBABILISTIC) & F.col("percentiles").isNull(),
        "length is negative": F.col("length") < 0,
    }


def malformed(associations: DataFrame) -> DataFrame:
    """(assoc_id, problem): every rule that a row breaks."""
    numbers = {f"__{c}": Periods.of(F.col(c)).n for c in ("resolution", "horizon", "interval")}
    rows = associations.withColumns(numbers)
    broken = [F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules().items()]
    return rows.select("assoc_id", F.explode(F.array_compact(F.array(*broken))).alias("problem"))


def _named(associations: DataFrame, key: str, hashes: DataFrame, problem: str) -> DataFrame:
    """The rows that refer to one of hashes (key), with a problem."""
    return associations.join(hashes.select(key), key, "left_semi").select("assoc_id", F.lit(problem).alias("problem"))


def changed_arrays(referenced: DataFrame, arrays: DataFrame) -> DataFrame:
    """(data_hash) of arrays whose content has another hash; each is hashed once."""
    now = content_hash(*map(F.col, ("dtype", "shape", "values", "exact")))
    held = arrays.join(referenced, "data_hash", "left_semi").withColumn("__now", now)
    return held.where(F.col("__now") != F.col("data_hash")).select("data_hash")


def verified(associations: DataFrame, arrays: DataFrame, timestamp_sets: DataFrame) -> DataFrame:
    """(assoc_id, problem) of all rules: the catalog's own, then those of what it refers to."""
    sound = associations.where(F.coalesce(F.col("data_hash").rlike(HASH), F.lit(False)))
    referenced = sound.select("data_hash").distinct()
    missing = referenced.join(arrays.select("data_hash"), "data_hash", "left_anti")
    vectors = associations.where((F.col("time_series_type") == IRREGULAR) & F.col("timestamps_hash").isNotNull())
    no_vector = vectors.select("timestamps_hash").distinct().join(timestamp_sets.select("timestamps_hash"), "timestamps_hash", "left_anti")
    refs = sound.groupBy("data_hash").agg(
        F.count_if(F.col("time_series_type") == DERIVED).alias("views"), F.count_if(F.col("time_series_type") == SINGLE).alias("singles")
    )
    views = sound.where(F.col("time_series_type") == DERIVED)
    return (
        malformed(associations)
        .union(_named(sound, "data_hash", missing, "array is missing"))
        .union(_named(sound, "data_hash", changed_arrays(referenced, arrays), "array has another hash"))
        .union(_named(vectors, "timestamps_hash", no_vector, "timestamps are not stored"))
        .union(_named(views, "data_hash", refs.where("views > 0 and singles = 0"), "view without its series"))
    )
