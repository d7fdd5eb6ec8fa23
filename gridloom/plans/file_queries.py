"""Queries that write files of the series, read them back, and check what stands in tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..functions.elements import as_doubles
from ..functions.period import Period, instant
from ..functions.tables import shared_folder
from ..operators import catalog, chunks, diagnostics, feature_sets, grids, ranges, series, slots
from ..operators.filters import ListFilter
from ..sources import csv_io, link_json, series_files, typed_csv
from ..schema import ATTRIBUTE_LINKS
from . import fixtures as fx
from .series_queries import _PERCENTILES, _QUANTILES, _probabilistic, _scenarios

HOUR, DAY, TWO_DAYS, MONTH = map(Period.parse, ("PT1H", "P1D", "P2D", "P1M"))
_OWNER = ["owner_id", "name"]
_AT = dt.datetime(2024, 1, 21)
_A, _H = f"WITH {fx.SQL_ASSOC}", f"WITH {fx.SQL_HOURLY}"


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# slots
def _doubled(spark, d):
    """Each series stored for two owners, on one array."""
    a = fx.associations(spark, d)
    again = a.withColumns({"owner_id": F.col("owner_id") + 5_000_000, "assoc_id": F.col("assoc_id") + 5_000_000_000})
    return a.unionByName(again)


def _read_by_slots(spark, d):
    entries = _doubled(spark, d).where("time_series_type > 1 or resolution = 'PT1H'")
    out = slots.read_at(entries, fx.arrays(spark, d), fx.timestamp_sets(spark, d), instant(_AT), ["assoc_id"])
    return out.select("assoc_id", F.posexplode("values").alias("h", "v")).select(
        "assoc_id",
        F.col("h").cast("long").alias("h"),
        F.col("v").cast("long").alias("v"),
    )


def _slot_reads(spark, d):
    """How many entries and slots there are, and how many arrays are read for them."""
    entries = slots.slotted(_doubled(spark, d).where("time_series_type > 1 or resolution = 'PT1H'"))
    found = slots.slots_of(entries)
    reads = slots.read_slots(found, fx.arrays(spark, d), fx.timestamp_sets(spark, d), instant(_AT))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    return one(entries, "entries").union(one(found, "slots")).union(one(reads, "reads"))


_SLOTS = """x AS (
  SELECT assoc_id, owner_id, name, time_series_type, CASE time_series_type WHEN 0 THEN 1 WHEN 3 THEN 48 ELSE 24 END AS steps
  FROM assoc WHERE time_series_type > 1 OR resolution = 'PT1H')"""


# feature sets
def _by_set(fn):
    def query(spark, d):
        rows, sets = feature_sets.split(fx.associations(spark, d))
        return fn(rows, sets)

    return query


def _hydrated(rows, sets):
    out = feature_sets.hydrated(rows, sets)
    return out.select("assoc_id", F.col("features")["year"]["i"].alias("year"), F.col("features")["segment"]["s"].alias("segment"))


# links
def _exported(spark, d):
    links = fx.attribute_links(spark, d)
    return links.select(
        "component_id",
        "attribute_id",
        F.to_json(F.struct("component_id", "component_type", "attribute_id", "attribute_type")).alias("json"),
    )


def _imported(spark, d):
    none = spark.createDataFrame([], ATTRIBUTE_LINKS)
    return link_json.imported(_exported(spark, d).select("json"), none).drop("id")


def _refused(spark, d):
    """Faults of every kind in the exported rows, by the component's id, and what is said of each."""
    bad = {
        1: F.regexp_replace("json", r"\}$", ',"note":"x"}'),
        2: F.regexp_replace("json", r'"component_id":([0-9]+)', '"component_id":"$1"'),
        3: F.regexp_replace("json", r',"attribute_type":"[^"]*"', ""),
        4: F.substring("json", 2, 1000),
    }
    json = F.col("json")
    for k, text in bad.items():
        json = F.when(F.col("component_id") % 7 == k, text).otherwise(json)
    rows = _exported(spark, d)
    twice = rows.where("component_id % 7 = 5 and attribute_id % 2 = 0")
    planted = rows.select(json.alias("json")).union(twice.select("json"))
    stored = fx.attribute_links(spark, d).where("component_id % 7 = 6")
    return link_json.problems(planted, stored).groupBy("problem").agg(F.count(F.lit(1)).alias("rows"))


# diagnostics
def _content(spark, d):
    """The catalog and its arrays under the hashes of their content."""
    arrays = fx.arrays(spark, d)
    from ..functions.tables import ARRAY_ROWS, written
    from ..operators.merging import _hashed

    hashed = written(_hashed(arrays), "hashed", ARRAY_ROWS)
    rows = fx.associations(spark, d).join(hashed.select("data_hash", "new_hash"), "data_hash")
    rows = rows.withColumn("data_hash", F.col("new_hash")).drop("new_hash").withColumn("percentiles", F.lit(None).cast("array<double>"))
    return rows, hashed


def _diagnosed(spark, d):
    """Faults planted by the owner's id: in the catalog, in arrays, in vectors."""
    rows, hashed = _content(spark, d)
    k = F.col("owner_id") % 13
    plant = lambda case, value, column: F.when(k == case, value).otherwise(F.col(column))
    rows = rows.withColumns(
        {
            "data_hash": F.when(k == 1, F.lit("0xyz")).when(k == 9, F.sha2("data_hash", 256)).otherwise(F.col("data_hash")),
            "element_type": plant(2, F.lit("f65"), "element_type"),
            "resolution": F.when((k == 3) & (F.col("time_series_type") == 0), F.lit("1 hour")).otherwise(F.col("resolution")),
            "horizon": F.when((k == 4) & (F.col("time_series_type") > 1), F.lit(None)).otherwise(F.col("horizon")),
            "timestamps_hash": plant(5, F.lit("none"), "timestamps_hash"),
            "owner_category": plant(6, F.lit("Thing"), "owner_category"),
            "length": F.when(k == 2, F.lit(-1)).otherwise(F.col("length")),
        }
    )
    changed = rows.where("owner_id % 13 = 7").select("data_hash").distinct().withColumn("__bad", F.lit(True))
    arrays = hashed.withColumn("data_hash", F.col("new_hash")).drop("new_hash").dropDuplicates(["data_hash"]).join(changed, "data_hash", "left")
    arrays = arrays.withColumn("values", F.when(F.col("__bad"), F.transform("values", lambda x: x + 1)).otherwise(F.col("values"))).drop("__bad")
    return diagnostics.verified(rows, arrays, fx.timestamp_sets(spark, d))


_FAULTS = """k AS (SELECT assoc_id, owner_id % 13 AS k, time_series_type AS t FROM assoc)
SELECT assoc_id, unnest(list_filter([
  CASE WHEN k = 1 THEN 'data_hash is no hash' END,
  CASE WHEN k = 2 THEN 'element_type is invalid' END,
  CASE WHEN k = 2 THEN 'length is negative' END,
  CASE WHEN k = 3 AND t = 0 THEN 'resolution is no positive period' END,
  CASE WHEN k = 4 AND t > 1 THEN 'horizon, interval or count is missing' END,
  CASE WHEN k = 5 AND t = 1 THEN 'timestamps are not stored' END,
  CASE WHEN k = 6 THEN 'owner_category is unknown' END,
  CASE WHEN k = 7 THEN 'array has another hash' END,
  CASE WHEN k = 9 THEN 'array is missing' END], lambda x: x IS NOT NULL)) AS problem FROM k"""


# grids
def _bare_grid(spark, d):
    """Owners' columns of one series name, brought back to rows."""
    rows = fx.associations(spark, d).where("time_series_type = 0 and name = 'view'").join(fx.arrays(spark, d), "data_hash")
    wide = grids.blocks(rows, ["owner_id"], HOUR)
    long = wide.select("t", F.explode(F.arrays_zip(F.col("columns").alias("label"), F.col("cells").alias("v"))).alias("x"))
    return long.select("t", "x.label", F.col("x.v").cast("long").alias("v"))


def _element_grid(spark, d):
    """Clicks and views of the owners 1 to 9 as pairs, labelled in full, a column for each element."""
    h = fx.hourly(spark, d).where("owner_id between 1 and 9 and name in ('click', 'view')")
    pairs = h.groupBy("owner_id", "initial_timestamp").agg(F.map_from_entries(F.collect_list(F.struct("name", "values"))).alias("m"))
    zero = F.array_repeat(F.lit(0).cast("long"), fx.HOURS)
    both = F.arrays_zip(
        F.coalesce(F.try_element_at("m", F.lit("click")), zero).alias("a"),
        F.coalesce(F.try_element_at("m", F.lit("view")), zero).alias("b"),
    )
    flat = F.flatten(F.transform(both, lambda x: F.array(x["a"], x["b"])))
    names = F.when(F.col("owner_id") % 2 == 0, "even").otherwise("odd")
    rows = pairs.select(
        "owner_id",
        names.alias("name"),
        "initial_timestamp",
        F.lit(0).alias("time_series_type"),
        F.array(F.lit(2)).alias("element_shape"),
        flat.alias("values"),
    )
    wide = grids.grid(rows.orderBy("owner_id"), HOUR)
    long = wide.unpivot(["t"], [c for c in wide.columns if c != "t"], "label", "v")
    return long.select("t", "label", "v")


# files
def _files(spark, d):
    path = _folder(spark, "series")
    rows = fx.associations(spark, d).where("time_series_type = 0 and resolution = 'PT1H'").join(fx.arrays(spark, d), "data_hash")
    names = series_files.write(
        rows.select("assoc_id", "owner_id", "owner_type", "name", "time_series_type", "resolution", "interval", "initial_timestamp", "values"),
        HOUR,
        path,
        packed=True,
    )
    back = series_files.read(spark, path).groupBy("stem").agg(
        F.countDistinct("file").alias("files"),
        F.count(F.lit(1)).alias("rows"),
        F.sum("v").cast("long").alias("total"),
        F.max("t").alias("last"),
    )
    return back.join(names, "stem").select("assoc_id", "files", "rows", "total", "last")


def _one_file(df, path: str) -> str:
    """df as one CSV file with a header, whose rows keep their order."""
    df.coalesce(1).write.option("header", True).csv(path)
    return path


def _forecast_file(spark, windows, name: str, labels: list[str], description: dict):
    """The windows of one forecast written as CSV, and the series that the file gives with the description."""
    path = _one_file(csv_io.forecast_rows(windows, labels), _folder(spark, name))
    return typed_csv.typed_series(spark, path, description)


_FORECAST = {"initial_timestamp": "2024-01-01T00:00:00Z", "resolution": "PT1H", "horizon": "P1D", "interval": "P1D", "count": 30}


def _windows_of(rows):
    return series.dense_windows(rows, [], 24, HOUR, DAY).select("p", "w", "h", "v", "issue_time", "target_time")


def _deterministic_file(spark, d):
    """The sum of all series of clicks as a forecast."""
    total = series.steps(fx.hourly(spark, d).where("name = 'click'"), HOUR, []).groupBy("idx").agg(F.sum("v").alias("v"))
    at = {"w": F.floor(F.col("idx") / 24), "h": F.col("idx") % 24, "p": F.lit(0)}
    rows = total.select(*[c.cast("long").alias(k) for k, c in at.items()], "v")
    issue = DAY.add(instant(fx.T0), F.col("w"))
    rows = rows.withColumn("issue_time", issue).withColumn("target_time", HOUR.add(issue, F.col("h")))
    back = _forecast_file(spark, rows, "deterministic", ["value"], {"time_series_type": "Deterministic", "name": "click", **_FORECAST})
    return _windows_of(back).drop("p").withColumn("v", F.col("v").cast("long"))


def _probabilistic_file(spark, d):
    rows = _probabilistic(fx.hourly(spark, d)).where("name = 'view'")
    back = _forecast_file(
        spark,
        rows,
        "probabilistic",
        [f"p{int(p)}" for p in _PERCENTILES],
        {"time_series_type": "Probabilistic", "name": "view", "percentiles": list(_PERCENTILES), **_FORECAST},
    )
    return _windows_of(back).select("p", "w", "h", F.round("v", 4).alias("v"))


def _scenarios_file(spark, d):
    """The number of scenarios follows from the file."""
    rows = _scenarios(fx.hourly(spark, d)).where("name = 'view'")
    back = _forecast_file(spark, rows, "scenarios", [f"s{k}" for k in range(5)], {"time_series_type": "Scenarios", "name": "view", **_FORECAST})
    return _windows_of(back).select("p", "w", "h", F.col("v").cast("long").alias("v"))


def _total(spark, d):
    total = series.steps(fx.hourly(spark, d), HOUR, []).groupBy("idx").agg(F.sum("v").alias("v"))
    return total.select("idx", HOUR.add(instant(fx.T0), F.col("idx")).alias("t"), "v")


def _static_file(spark, d, timestamps: bool):
    rows = _total(spark, d).orderBy("idx")
    columns = [csv_io.wire_instant(F.col("t")).alias("timestamp")] * timestamps + [F.col("v").alias("value")]
    path = _one_file(rows.select(*columns), _folder(spark, "static"))
    back = typed_csv.typed_series(spark, path, {"name": "total", "initial_timestamp": "2024-01-01T00:00:00Z", "resolution": "PT1H"})
    return series.steps(back, HOUR, []).select("idx", "t", F.col("v").cast("long").alias("v"))


def _irregular_file(spark, d):
    """The first event of each owner, by owner and instant, as one irregular series."""
    first = fx.irregular(spark, d).select(
        F.get("timestamps", F.lit(0)).alias("t"),
        F.get("values", F.lit(0)).alias("v"),
    ).groupBy("t").agg(F.sum("v").alias("v"))
    rows = first.orderBy("t").select(csv_io.wire_instant(F.col("t")).alias("timestamp"), F.col("v").alias("value"))
    back = typed_csv.typed_series(
        spark,
        _one_file(rows, _folder(spark, "irregular")),
        {"time_series_type": "NonSequentialTimeSeries", "name": "first"},
    )
    pairs = back.select(F.explode(F.arrays_zip("timestamps", "values")).alias("x"))
    return pairs.select(F.col("x.timestamps").alias("t"), F.col("x.values").cast("long").alias("v"))


def _wide_file(spark, d):
    """Totals by event type as columns of one file, and each column as a series of its own."""
    totals = series.steps(fx.hourly(spark, d), HOUR, ["name"]).groupBy("name", "idx", "t").agg(F.sum("v").alias("v"))
    wide = totals.groupBy("idx", "t").pivot("name", fx.EVENTS).agg(F.first("v")).orderBy("idx")
    path = _one_file(wide.select(csv_io.wire_instant(F.col("t")).alias("timestamp"), *fx.EVENTS), _folder(spark, "wide"))
    back = csv_io.read_wide(spark, path, {name: i for i, name in enumerate(fx.EVENTS)})
    long = back.select("owner_id", "column", F.posexplode("values").alias("idx", "v"))
    return long.select("owner_id", "column", F.col("idx").cast("long").alias("idx"), F.col("v").cast("long").alias("v"))


_TOTAL = "SELECT idx, any_value(t) AS t, sum(v)::BIGINT AS v FROM hourly GROUP BY idx"


# chunks
def _chunked(spark, d):
    path = _folder(spark, "chunks")
    chunks.write(fx.arrays(spark, d), path)
    return chunks.read(spark, path)


def _keyed(spark, d, found):
    keys = fx.associations(spark, d).where("time_series_type = 0 and resolution = 'PT1H'").select("data_hash", *_OWNER)
    return found.join(keys, "data_hash")


def _at_step(spark, d):
    found = _keyed(spark, d, chunks.at_step(_chunked(spark, d), 267))
    return found.select(*_OWNER, F.get("values", F.lit(0)).cast("long").alias("v"))


def _between_steps(spark, d):
    found = _keyed(spark, d, chunks.between(_chunked(spark, d), 250, 310))
    return found.select(*_OWNER, F.posexplode("values").alias("i", "v")).select(
        *_OWNER,
        (F.col("i") + 250).cast("long").alias("idx"),
        F.col("v").cast("long").alias("v"),
    )


def _axis_slice(spark, d):
    """Rows 5 to 8 of every array's first axis: steps of series, and horizon steps of dense forecasts."""
    cut = ranges.axis_slice(fx.arrays(spark, d), 5, 9)
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x).cast("long").alias("total")
    rows = fx.associations(spark, d).where("time_series_type in (0, 2)").join(cut, "data_hash")
    return rows.select("assoc_id", F.size("values").cast("long").alias("n"), F.element_at("shape", 1).cast("long").alias("first_axis"), total)


def _pairs_of_totals(spark, d):
    """Totals of clicks and views as one series of pairs, written as CSV with a column for each element, and read back."""
    h = series.steps(fx.hourly(spark, d).where("name in ('click', 'view')"), HOUR, ["name"])
    both = h.groupBy("idx").agg(*[F.sum(F.when(F.col("name") == n, F.col("v")).otherwise(0)).alias(n) for n in ("click", "view")])
    flat = both.agg(F.array_sort(F.collect_list(F.struct("idx", F.array("click", "view").alias("v")))).alias("p"))
    pairs = flat.select(F.flatten("p.v").alias("values"), instant(fx.T0).alias("initial_timestamp"))
    path = _one_file(csv_io.static_rows(pairs, HOUR, 2), _folder(spark, "pairs"))
    about = {"name": "pairs", "initial_timestamp": "2024-01-01T00:00:00Z", "resolution": "PT1H", "element_type": "tuple(2,f64)", "element_shape": [2]}
    back = typed_csv.typed_series(spark, path, about)
    cells = back.select(F.posexplode("values").alias("i", "v"))
    return cells.select(
        F.floor(F.col("i") / 2).cast("long").alias("idx"),
        (F.col("i") % 2).cast("long").alias("e"),
        F.col("v").cast("long").alias("v"),
    )


def _lossy(spark, d):
    """Statistics of 64-bit unsigned series: every value 2 ** 63 larger, exact until they are asked for."""
    large = F.transform("values", lambda x: x.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)"))
    rows = fx.hourly(spark, d).select(*_OWNER, large.cast("array<decimal(20,0)>").alias("exact"), F.lit(None).cast("array<double>").alias("values"))
    out = catalog.statistics(rows.withColumn("values", as_doubles()), _OWNER)
    return out.select(*_OWNER, "num_elements", "non_finite", "first", "last", "min", "max")


_BIG = "(v::HUGEINT + 9223372036854775808)::DOUBLE"

QUERIES = {
    "RDR_6_read_by_slots": (
        _read_by_slots,
        f"""{_A}, {fx.SQL_HOURLY}, {_SLOTS}
SELECT x.assoc_id + 5000000000 * c AS assoc_id, h.idx - 480 AS h, v FROM x JOIN hourly h USING (owner_id, name) JOIN range(2) r(c) ON true
WHERE h.idx >= 480 AND h.idx < 480 + steps""",
    ),
    "RDR_6_slot_reads": (
        _slot_reads,
        f"{_A}, {_SLOTS} SELECT unnest(['entries', 'slots', 'reads']) AS what, unnest([2 * count(*), count(*), count(*)]) AS n FROM x",
    ),
    "JON_1_feature_sets": (_by_set(_hydrated), f"{_A} SELECT assoc_id, year, segment FROM assoc"),
    "FLT_11_feature_sets": (
        _by_set(lambda rows, sets: feature_sets.with_features(rows, sets, {"year": 2025}).select("assoc_id")),
        f"{_A} SELECT assoc_id FROM assoc WHERE year = 2025",
    ),
    "FLT_12_feature_sets": (
        _by_set(lambda rows, sets: feature_sets.with_exactly(rows, sets, {"year": 2025, "segment": "c"}).select("assoc_id")),
        f"{_A} SELECT assoc_id FROM assoc WHERE year = 2025 AND segment = 'c'",
    ),
    "SRC_24_import_links": (_imported, f"WITH {fx.SQL_LINKS} SELECT component_id, component_type, attribute_id, attribute_type FROM links"),
    "SRC_24_refused_links": (
        _refused,
        f"""WITH {fx.SQL_LINKS}, p AS (SELECT CASE component_id % 7 WHEN 1 THEN 'unknown field note' WHEN 2 THEN 'wrong type of component_id'
  WHEN 3 THEN 'missing field attribute_type' WHEN 4 THEN 'no object' WHEN 6 THEN 'stored pair' END AS problem FROM links
  UNION ALL SELECT 'repeated pair' FROM links, range(2) WHERE component_id % 7 = 5 AND attribute_id % 2 = 0)
SELECT problem, count(*) AS rows FROM p WHERE problem IS NOT NULL GROUP BY problem""",
    ),
    "LST_16_TXN_3_diagnostics": (_diagnosed, f"{_A}, {_FAULTS}"),
    "RDR_8_grid_of_one_name": (_bare_grid, f"{_H} SELECT t, owner_id::VARCHAR AS label, v FROM hourly WHERE name = 'view'"),
    "RDR_8_grid_of_elements": (
        _element_grid,
        f"""{_H}, o AS (SELECT DISTINCT owner_id FROM hourly WHERE owner_id BETWEEN 1 AND 9 AND name IN ('click', 'view')),
g AS (SELECT o.owner_id, e.e, i.idx FROM o JOIN range(2) e(e) ON true JOIN range(720) i(idx) ON true)
SELECT TIMESTAMP '2024-01-01' + to_hours(g.idx::INT) AS t,
  CASE g.owner_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END || '@' || g.owner_id || '[' || e || ']' AS label, coalesce(h.v, 0)::BIGINT AS v
FROM g LEFT JOIN hourly h ON h.owner_id = g.owner_id AND h.idx = g.idx AND h.name = CASE e WHEN 0 THEN 'click' ELSE 'view' END""",
    ),
    "SNK_4_file_by_series": (
        _files,
        f"""{_A}, {fx.SQL_HOURLY} SELECT assoc_id, 1::BIGINT AS files, count(*) AS rows, sum(v)::BIGINT AS total, max(t) AS last
FROM assoc JOIN hourly USING (owner_id, name) WHERE time_series_type = 0 GROUP BY assoc_id""",
    ),
    "SRC_15_values_file": (lambda spark, d: _static_file(spark, d, False), f"{_H} {_TOTAL}"),
    "SRC_18_timestamped_file": (lambda spark, d: _static_file(spark, d, True), f"{_H} {_TOTAL}"),
    "SRC_20_wide_file": (
        _wide_file,
        f"{_H} SELECT list_position({fx.EVENTS}, name) - 1 AS owner_id, name AS \"column\", idx, sum(v)::BIGINT AS v FROM hourly GROUP BY name, idx",
    ),
    "SRC_23_irregular_file": (
        _irregular_file,
        f"""WITH {fx.SQL_IRREGULAR}, f AS (SELECT owner_id, first(t ORDER BY t, v) AS t, first(v ORDER BY t, v) AS v FROM activity GROUP BY owner_id)
SELECT t, sum(v)::BIGINT AS v FROM f GROUP BY t""",
    ),
    "SRC_23_deterministic_file": (
        _deterministic_file,
        f"""{_H} SELECT idx // 24 AS w, idx % 24 AS h, sum(v)::BIGINT AS v, TIMESTAMP '2024-01-01' + to_days((idx // 24)::INT) AS issue_time,
any_value(t) AS target_time FROM hourly WHERE name = 'click' GROUP BY idx""",
    ),
    "SRC_23_probabilistic_file": (
        _probabilistic_file,
        f"{_H} SELECT p::BIGINT AS p, idx // 24 AS w, idx % 24 AS h, round(v, 4) AS v {_QUANTILES} WHERE name = 'view'",
    ),
    "SRC_23_scenarios_file": (
        _scenarios_file,
        f"{_H} SELECT owner_id % 5 AS p, idx // 24 AS w, idx % 24 AS h, sum(v)::BIGINT AS v FROM hourly WHERE name = 'view' GROUP BY ALL",
    ),
    "SRC_9_chunk_at_index": (_at_step, f"{_H} SELECT owner_id, name, v FROM hourly WHERE idx = 267"),
    "SRC_7_chunks_between": (_between_steps, f"{_H} SELECT owner_id, name, idx, v FROM hourly WHERE idx >= 250 AND idx < 310"),
    "SRC_7_axis_slice": (
        _axis_slice,
        f"""{_A}, {fx.SQL_HOURLY}, {fx.SQL_MONTHLY},
x AS (
  SELECT assoc_id, CASE time_series_type WHEN 0 THEN idx ELSE idx % 24 END AS place, v FROM assoc JOIN hourly USING (owner_id, name) WHERE time_series_type IN (0, 2)
  UNION ALL SELECT assoc_id, idx, v FROM assoc JOIN monthly USING (name) WHERE resolution = 'P1M')
SELECT assoc_id, count(*) AS n, 4::BIGINT AS first_axis, sum(v)::BIGINT AS total FROM x WHERE place BETWEEN 5 AND 8 GROUP BY assoc_id""",
    ),
    "SNK_1_element_columns": (
        _pairs_of_totals,
        f"""{_H}, h AS (SELECT * FROM hourly WHERE name IN ('click', 'view'))
SELECT idx, e::BIGINT AS e, coalesce(sum(v) FILTER (WHERE name = CASE e WHEN 0 THEN 'click' ELSE 'view' END), 0)::BIGINT AS v FROM h JOIN range(2) r(e) ON true GROUP BY idx, e""",
    ),
    "ARR_11_lossy_statistics": (
        _lossy,
        f"""{_H} SELECT owner_id, name, count(*) AS num_elements, 0::BIGINT AS non_finite, arg_min({_BIG}, idx) AS first,
arg_max({_BIG}, idx) AS last, min({_BIG}) AS min, max({_BIG}) AS max FROM hourly GROUP BY owner_id, name""",
    ),
}
