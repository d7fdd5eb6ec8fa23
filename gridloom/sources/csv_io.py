"""Series from CSV, and series and catalog rows to CSV and JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..functions.period import Period, instant, wire_instant
from ..operators.catalog import typed_order
from ..operators.series import steps


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(row, cells) of one file in its order; row 0 is the header. Quoted cells may hold commas, but no line breaks.

    Blocks of the file are read apart; a row's number is that within its block after the rows of the blocks before.
    """
    raw = spark.read.text(path)
    rows = raw.select(
        F.regexp_replace("value", "\r$", "").alias("line"),
        F.col("_metadata.file_block_start").alias("__b"),
        F.monotonically_increasing_id().alias("__m"),
    )
    blocks = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"), F.min("__m").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a block
    rows = rows.join(F.broadcast(blocks.select("__b", "__first", before.alias("__before"))), "__b")
    return rows.select((F.col("__before") + F.col("__m") - F.col("__first")).alias("row"), cells(F.col("line")).alias("cells"))


def cells(line: Column) -> Column:
    """The cells of a line; in quotes, a doubled quote stands for one."""
    bare = lambda x: F.when(x.startswith('"'), F.regexp_replace(F.regexp_replace(x, '^"|"$', ""), '""', '"')).otherwise(x)
    quoted = F.transform(F.regexp_extract_all(line, F.lit(r'(?:^|,)\x20*+("(?:[^"]++|"")*+"|[^,"]*+)'), F.lit(1)), bare)
    return F.when(line.contains('"'), quoted).otherwise(F.split(line, ","))


def header(spark: SparkSession, path: str) -> list[str]:
    """The header, whose first cell must not look like data (the columns of a wide table may be named by numbers)."""
    names = [c.strip() for c in lines(spark, path).where("row = 0").first()["cells"]]
    try:
        float(names[0])
    except ValueError:
        return names
    raise InvalidParameter(f"the first row must be a header, not data: {names[0]}")


def layout(names: list[str]) -> str:
    """values, timestamped or forecast, going by the header."""
    low = [n.lower() for n in names]
    if low[:2] == ["issue_time", "target_time"]:
        return "forecast"
    return "timestamped" if low[:1] == ["timestamp"] else "values"


def read_values(spark: SparkSession, path: str, leading: int = 0) -> DataFrame:
    """One row a file: values in row-major order of the columns after the leading ones."""
    names = header(spark, path)
    cells = lines(spark, path).where("row > 0").select("row", F.posexplode(F.slice("cells", leading + 1, len(names))).alias("col", "x"))
    places = cells.agg(F.array_sort(F.collect_list(F.struct("row", "col", F.trim("x").cast("double").alias("v")))).alias("p"))
    return places.select(F.col("p.v").alias("values"))


def read_timestamped(spark: SparkSession, path: str) -> DataFrame:
    """(row, t, v array) of a file with a timestamp column."""
    rows = lines(spark, path).where("row > 0").withColumnRenamed("row", "line")
    # the header is left out of the cast itself too, as the engine may cast before it filters
    numbers = F.transform(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))), lambda x: F.trim(x).cast("double"))
    t = F.to_timestamp(F.trim(F.element_at("cells", 1))).cast("timestamp_ntz")
    of_data = F.col("line") > 0
    return rows.select((F.col("line") - 1).alias("row"), F.when(of_data, t).alias("t"), F.when(of_data, numbers).alias("v"))


def read_forecast(spark: SparkSession, path: str) -> DataFrame:
    """(row, issue_time, target_time, v array) of a file with both times."""
    rows = lines(spark, path).where("row > 0").withColumnRenamed("row", "line")
    # the header is left out of the casts themselves too, as in read_timestamped()
    of_data = F.col("line") > 0
    numbers = F.transform(F.slice("cells", 3, F.greatest(F.size("cells") - 2, F.lit(0))), lambda x: F.trim(x).cast("double"))
    t = lambda i: F.when(of_data, F.to_timestamp(F.trim(F.element_at("cells", i))).cast("timestamp_ntz"))
    return rows.select((F.col("line") - 1).alias("row"), t(1).alias("issue_time"), t(2).alias("target_time"), F.when(of_data, numbers).alias("v"))


def check_grid(rows: DataFrame, initial, resolution: Period, length: int) -> None:
    """Every timestamp must be initial + row * resolution, for exactly length rows."""
    n = rows.count()
    if n != length:
        raise InvalidParameter(f"{n} rows, not {length}")
    off = rows.where(resolution.add(instant(initial), F.col("row")) != F.col("t")).orderBy("row").limit(1).collect()
    if off:
        raise InvalidParameter(f"row {off[0]['row']} is off the grid: {off[0]['t']}")


def forecast_values(rows: DataFrame, steps_: int, count: int, leading: int, width: int = 1) -> DataFrame:
    """(values) of a dense forecast [leading, steps, count, width] from rows (w, h, v array): window by window, each with the series side by side."""
    cell = rows.select("w", "h", F.posexplode("v").alias("k", "x"))
    s, e = F.floor(F.col("k") / width), F.col("k") % width
    place = ((s * steps_ + F.col("h")) * count + F.col("w")) * width + e
    return cell.agg(
        F.array_sort(F.collect_list(F.struct(place.cast("long").alias("i"), F.col("x").alias("v")))).alias("p"),
    ).select(F.col("p.v").alias("values"))


def owner_map(spark: SparkSession, path: str) -> DataFrame:
    """(column, owner_id, owner_type) of a file column,owner_id[,owner_type]; its header is checked, and a column may stand once."""
    names = header(spark, path)
    if names not in (["column", "owner_id"], ["column", "owner_id", "owner_type"]):
        raise InvalidParameter(f"an owner map has the columns column, owner_id and perhaps owner_type, not {', '.join(names)}")
    rows = lines(spark, path).where("row > 0")
    column = F.trim(F.element_at("cells", 1))
    owner = F.trim(F.get("cells", F.lit(1))).try_cast("long")
    out = rows.select(column.alias("column"), owner.alias("owner_id"), F.nullif(F.trim(F.get("cells", F.lit(2))), F.lit("")).alias("owner_type"))
    bad = out.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.count("owner_id").alias("ids")).where("n > 1 or ids = 0").limit(1).collect()
    if bad:
        raise InvalidParameter(f"column {bad[0]['column']!r} stands twice, or has no owner")
    return out


def read_wide(spark: SparkSession, path: str, owners: DataFrame | dict | None = None) -> DataFrame:
    """(owner_id, owner_type, column, values): one series a column. Owners by a table (column, owner_id, owner_type), a mapping, or the header."""
    names = header(spark, path)[1:]
    rows = read_timestamped(spark, path).select("row", F.posexplode("v").alias("k", "x"))
    series = rows.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "x"))), lambda p: p["x"]).alias("values"))
    series = series.withColumn("column", F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1))
    if owners is None:
        owners = {n: int(n) for n in names if n.lstrip("-").isdigit()}
    if isinstance(owners, dict):
        pairs = [(k, *(v if isinstance(v, tuple) else (v, None))) for k, v in owners.items()]
        owners = spark.createDataFrame(pairs, "column string, owner_id long, owner_type string")
    missing = [r[0] for r in series.join(owners, "column", "left_anti").select("column").orderBy("column").limit(11).collect()]
    if missing:
        raise InvalidParameter(f"columns without an owner: {', '.join(missing[:10])}{' ...' if len(missing) > 10 else ''}")
    return series.join(F.broadcast(owners), "column").select("owner_id", "owner_type", "column", "values")


def descriptor(text: str, allowed: set[str]) -> list[dict]:
    """An object or a list of them; unknown keys are refused."""
    found = json.loads(text)
    items = found if isinstance(found, list) else [found]
    for item in items:
        if unknown := set(item) - allowed:
            raise InvalidParameter(f"unknown keys: {', '.join(sorted(unknown))}")
    return items


def static_rows(rows: DataFrame, resolution: Period, width: int = 1) -> DataFrame:
    """timestamp and value of single series, in order; for steps of several values, a column value_0, value_1, ... each."""
    if width == 1:
        return steps(rows, resolution, []).orderBy("idx").select(wire_instant(F.col("t")).alias("timestamp"), F.col("v").alias("value"))
    n = F.floor(F.size("values") / width).cast("int")
    tuples = F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n),
        lambda i: F.slice("values", i * width + 1, F.lit(width)),
    )
    out = rows.select("initial_timestamp", F.posexplode(tuples).alias("idx", "v")).orderBy("idx")
    t = resolution.add(F.col("initial_timestamp"), F.col("idx").cast("long"))
    return out.select(wire_instant(t).alias("timestamp"), *[F.get("v", F.lit(e)).alias(f"value_{e}") for e in range(width)])


def forecast_rows(windows: DataFrame, labels: list[str]) -> DataFrame:
    """issue_time, target_time and a column for each label (windows: p, issue_time, target_time, v)."""
    named = windows.withColumn("label", F.element_at(F.array(*map(F.lit, labels)), (F.col("p") + 1).cast("int")))
    out = named.groupBy("issue_time", "target_time").pivot("label", labels).agg(F.first("v"))
    return out.orderBy("issue_time", "target_time").withColumns({c: wire_instant(F.col(c)) for c in ("issue_time", "target_time")})


def wire_series(associations: DataFrame) -> DataFrame:
    """Catalog rows as JSON by typed identity; what is null is left out."""
    plain = F.transform_values("features", lambda k, v: F.coalesce(v["s"], v["i"].cast("string"), v["f"].cast("string"), v["b"].cast("string")))
    fields = [
        "owner_id",
        "owner_type",
        "owner_category",
        "name",
        wire_instant(F.col("initial_timestamp")).alias("initial_timestamp"),
        "resolution",
        "length",
        "horizon",
        "interval",
        "count",
        "units",
        "quantity_kind",
        "unit_system",
        "component_field",
        "percentiles",
        "element_type",
        "application_data",
        "data_hash",
    ]
    return associations.orderBy(*typed_order()).select(F.to_json(F.struct(*fields, plain.alias("features"))).alias("json"))


#: What row_json() reads back of wire_series().
WIRE = """owner_id bigint, owner_type string, owner_category string, name string, initial_timestamp string, resolution string, length bigint, horizon string, interval string, count bigint,
units string, quantity_kind string, unit_system string, component_field string, percentiles array<double>, element_type string, application_data string, data_hash string, features map<string,string>"""


def row_json(rows: DataFrame) -> DataFrame:
    """Catalog columns from JSON rows (json); a row that does not parse, or has no owner or name, is an error when it is read."""
    r = F.from_json("json", WIRE, {"mode": "FAILFAST"})
    out = rows.select(r.alias("r")).select("r.*")
    checked = F.when(
        F.col("owner_id").isNull() | F.col("name").isNull(),
        F.raise_error(F.lit("a row without an owner or a name")),
    ).otherwise(F.col("owner_id"))
    return out.withColumns({"owner_id": checked.cast("long"), "initial_timestamp": F.to_timestamp("initial_timestamp").cast("timestamp_ntz")})


def json_series(rows: DataFrame, resolution: Period, keep: list[str]) -> DataFrame:
    """(keep, json): each single series as one JSON array of timestamp and value."""
    entry = lambda v, i: F.struct(
        wire_instant(resolution.add(F.col("initial_timestamp"), i.cast("long"))).alias("timestamp"),
        v.alias("value"),
    )
    return rows.select(*keep, F.to_json(F.transform("values", entry)).alias("json"))


def json_lines(rows: DataFrame, resolution: Period, keep: list[str]) -> DataFrame:
    """(keep, idx, json): a JSON object for each step."""
    out = steps(rows, resolution, keep)
    return out.select(*keep, "idx", F.to_json(F.struct(wire_instant(F.col("t")).alias("timestamp"), F.col("v").alias("value"))).alias("json"))


SERIES_KEYS = frozenset("owner_id owner_type owner_category name initial_timestamp resolution length units".split())


def series_from_csv(spark: SparkSession, path: str, description: dict) -> DataFrame:
    """One row (the description's fields and values) of a file of single values, or of timestamps and values that stand on its grid."""
    if unknown := set(description) - SERIES_KEYS:
        raise InvalidParameter(f"unknown keys: {', '.join(sorted(unknown))}")
    names = header(spark, path)
    kind = layout(names)
    if kind == "forecast":
        raise InvalidParameter("a forecast file is not a single series")
    if kind == "timestamped":
        rows = read_timestamped(spark, path)
        check_grid(rows, description["initial_timestamp"], Period.parse(description["resolution"]), description.get("length", rows.count()))
    values = read_values(spark, path, leading=int(kind == "timestamped"))
    known = {k: F.lit(v) for k, v in description.items() if k not in ("initial_timestamp", "length")}
    return values.select(
        *[c.alias(k) for k, c in known.items()],
        instant(description["initial_timestamp"]).alias("initial_timestamp"),
        F.size("values").cast("long").alias("length"),
        "values",
    )


def file_stems(associations: DataFrame) -> DataFrame:
    """(assoc_id, stem): one name a series, distinct whatever the case; those that collide get identity and number."""
    clean = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9_.-]", "_")
    stem = clean(F.concat_ws("_", F.col("owner_type"), F.col("owner_id").cast("string"), F.col("name")))
    same = Window.partitionBy(F.lower("stem"))
    rows = associations.select(
        "assoc_id",
        stem.alias("stem"),
        "time_series_type",
        "resolution",
        "interval",
    ).withColumn("n", F.count(F.lit(1)).over(same))
    nth = F.row_number().over(same.orderBy("assoc_id"))
    tail = clean(
        F.concat_ws("_", F.col("stem"), F.col("time_series_type").cast("string"), F.col("resolution"), F.col("interval"), nth.cast("string")),
    )
    return rows.select("assoc_id", F.when(F.col("n") > 1, tail).otherwise(F.col("stem")).alias("stem"))
