"""Wide tables of static series: a row for each instant, a column for each series, or for each element of its steps.

The arrays of a table's columns are brought into one row and exploded side by side: no step is shuffled. A table of more
columns than Spark's plans can name is dealt into blocks of columns, which are arrays; see blocks().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameter, NotFound
from ..functions.period import Period
from ..functions.tables import written
from .ranges import step_width, up_to

#: A table has at most so many columns; wider ones are read by blocks().
MOST_COLUMNS = 4000
#: So many series stand side by side in a block.
BLOCK = 256


def side_by_side(rows: DataFrame, by: list[str], label: str, labels: list[str], resolution: Period) -> DataFrame:
    """(*by, t, a column for each of labels) of rows (by, label, initial_timestamp, values), one value a step.

    Series of one row of by share their grid; a label that is missing there is null throughout.
    """
    held = F.map_from_entries(F.collect_list(F.struct(F.col(label).alias("k"), F.col("values").alias("v"))))
    groups = rows.groupBy(*by, "initial_timestamp").agg(held.alias("__held"))
    # a series that is missing has no steps, which arrays_zip fills with nulls
    whole = [F.coalesce(F.try_element_at("__held", F.lit(name)), F.expr("array()")).alias(f"c{i}") for i, name in enumerate(labels)]
    groups = groups.select(*by, "initial_timestamp", F.arrays_zip(*whole).alias("__all"))
    steps = groups.select(*by, "initial_timestamp", F.posexplode("__all").alias("__i", "__x"))
    t = resolution.add(F.col("initial_timestamp"), F.col("__i").cast("long"))
    return steps.select(*by, t.alias("t"), *[F.col("__x")[f"c{i}"].alias(name) for i, name in enumerate(labels)])


def headers(series: DataFrame, label: str = "auto") -> list[tuple]:
    """(owner_id, name, element, column) of a table's columns, in the order of series.

    auto: the owner's id if all series share one name, else name@owner. owner and full: always the one or the other. Steps of
    several values have a column for each, numbered in brackets. Two columns of one name are an error.
    """
    rows = series.select("owner_id", "name", step_width().alias("width")).limit(MOST_COLUMNS + 1).collect()
    if not rows:
        raise NotFound("no series matches")
    if sum(r["width"] for r in rows) > MOST_COLUMNS:
        raise InvalidParameter(f"more than {MOST_COLUMNS} columns: read them by blocks")
    bare = label == "owner" or (label == "auto" and len({r["name"] for r in rows}) == 1)
    out = []
    for r in rows:
        name = str(r["owner_id"]) if bare else f"{r['name']}@{r['owner_id']}"
        out += [(r["owner_id"], r["name"], e, name if r["width"] == 1 else f"{name}[{e}]") for e in range(r["width"])]
    names = [column for *_, column in out]
    if len(set(names)) < len(names):
        raise InvalidParameter("two columns would have one name: choose full labels")
    return out


def blocks(series: DataFrame, by: list[str], resolution: Period, label: str = "auto") -> DataFrame:
    """(block, t, columns, cells): the table of grid() with any number of columns, BLOCK series of it a row, in the order of by.

    columns are names as those of headers(), cells their values at t. Names, grids and errors are those of grid().
    """
    held = written(series.select(*dict.fromkeys([*by, "owner_id", "name"]), "initial_timestamp", step_width().alias("__width"), "values"), "grid")
    seen = held.agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("a"), F.max("name").alias("b"), *[
        f("initial_timestamp").alias(k) for k, f in (("first", F.min), ("last", F.max))
    ]).first()
    if not seen["n"]:
        raise NotFound("no series matches")
    if seen["first"] != seen["last"]:
        raise InvalidParameter("the series do not share one grid")
    bare = label == "owner" or (label == "auto" and seen["a"] == seen["b"])
    name = F.col("owner_id").cast("string") if bare else F.concat_ws("@", "name", "owner_id")
    if held.groupBy(name.alias("k")).count().where("count > 1").limit(1).count():
        raise InvalidParameter("two columns would have one name: choose full labels")
    # numbers grow with the order, and those of one partition follow each other
    numbered = held.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__n", F.monotonically_increasing_id())
    numbered = written(numbered.withColumn("__name", name), "numbered")
    groups = numbered.groupBy(F.floor(F.col("__n") / BLOCK).alias("block"), "initial_timestamp").agg(
        F.array_sort(F.collect_list(F.struct("__n", "__name", "__width", "values"))).alias("__held")
    )
    element = lambda x, e: F.when(x["__width"] == 1, x["__name"]).otherwise(F.concat(x["__name"], F.lit("["), e.cast("string"), F.lit("]")))
    of = lambda x, fn: F.transform(F.sequence(F.lit(0).cast("long"), x["__width"] - 1), fn)
    columns = F.flatten(F.transform("__held", lambda x: of(x, lambda e: element(x, e))))
    length = F.array_max(F.transform("__held", lambda x: F.floor(F.size(x["values"]) / x["__width"])))
    # a series that ends early has no further cells
    row = lambda i: F.flatten(F.transform("__held", lambda x: of(x, lambda e: F.get(x["values"], (i * x["__width"] + e).cast("int")))))
    rows = F.transform(up_to(length), row)
    out = groups.select("block", "initial_timestamp", columns.alias("columns"), F.posexplode(rows).alias("__i", "cells"))
    return out.select("block", resolution.add(F.col("initial_timestamp"), F.col("__i").cast("long")).alias("t"), "columns", "cells")


def grid(series: DataFrame, resolution: Period, label: str = "auto", where: Column | None = None) -> DataFrame:
    """(t, columns) of series (owner_id, name, element_shape, time_series_type, initial_timestamp, values) that share one grid."""
    grids = series.select("initial_timestamp").distinct().limit(2).count()
    if grids > 1:
        raise InvalidParameter("the series do not share one grid")
    columns = headers(series, label)
    width = step_width()
    # each element of a step is a series of its own
    element = F.explode(F.sequence(F.lit(0).cast("long"), width - 1))
    rows = series.withColumn("__width", width).withColumn("__e", element)
    every = F.filter(F.col("values"), lambda x, i: i % F.col("__width") == F.col("__e"))
    rows = rows.select("owner_id", "name", "initial_timestamp", F.concat_ws("|", "owner_id", "__e", "name").alias("__key"), every.alias("values"))
    keys = [f"{owner}|{e}|{name}" for owner, name, e, _ in columns]
    wide = side_by_side(rows, [], "__key", keys, resolution)
    wide = wide.toDF("t", *[column for *_, column in columns])
    return wide if where is None else wide.where(where)
