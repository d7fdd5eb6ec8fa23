"""Literals, hashes, checks of what is added, and links that are added: what users write, over whole tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import parse_columns as pc
from ..functions.period import wire_instant
from ..functions.period_columns import Periods
from ..operators import catalog, links, series
from ..operators.filters import ListFilter
from ..schema import ATTRIBUTE_LINKS, COMPONENT_EDGES
from ..sources import csv_io, typed_csv
from ..sources.store import INCOMING, Store, hash_features
from . import fixtures as fx
from .file_queries import _folder, _one_file
from .store_queries import _as, _incoming, _store

_A, _H = f"WITH {fx.SQL_ASSOC}", f"WITH {fx.SQL_HOURLY}"
_OWNER = ["owner_id", "name"]


def _events(spark, d):
    return fx.table(spark, d, "events").select("event_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("at"), "user_id")


def _stamps(spark, d):
    """Seconds of events as RFC 3339 in UTC, with an offset, as epoch milliseconds, and without a zone."""
    e = _events(spark, d)
    k, local = F.col("event_id") % 4, lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    east = F.concat(local(F.timestamp_add("MINUTE", F.lit(150), F.col("at"))), F.lit("+02:30"))
    ms = F.unix_millis(F.col("at").cast("timestamp")).cast("string")
    west = local(F.timestamp_add("HOUR", F.lit(-7), F.col("at")))
    text = F.when(k == 0, wire_instant(F.col("at"))).when(k == 1, east).when(k == 2, ms).otherwise(west)
    return e.select("event_id", "at", text.alias("text"))


def _timestamps(spark, d):
    return _stamps(spark, d).select("event_id", pc.timestamp(F.col("text"), "-07:00").alias("t"))


def _ranges(spark, d):
    rows = _stamps(spark, d).select("event_id", F.concat("text", F.lit(".."), F.lit("2030-01-01T00:00:00Z")).alias("text"))
    return rows.select("event_id", pc.time_range(F.col("text"), "-07:00").alias("r")).select("event_id", "r.start", "r.end")


_AT = "date_trunc('second', ts)::TIMESTAMP"


def _periods(spark, d):
    """Periods as users write them, by order: hours, months, days and minutes, and text that is none."""
    o = fx.table(spark, d, "orders").select("o_orderkey")
    k, n = F.col("o_orderkey") % 5, (F.col("o_orderkey") % 97).cast("string")
    form = lambda a, b: F.concat(F.lit(a), n, F.lit(b))
    text = F.when(k == 0, form("PT", "H")).when(k == 1, form("P", "M")).when(
        k == 2,
        form("P", "DT30M"),
    ).when(k == 3, form("-P", "Y")).otherwise(form("P", "H"))
    rows = o.select("o_orderkey", text.alias("text"))
    p = Periods.of(F.col("text"))
    rows = rows.select("o_orderkey", p.kind.alias("kind"), p.n.alias("n"))
    return rows.select("*", (F.col("n") > 0).alias("positive"), (F.col("n") == 0).alias("zero"), (F.col("kind") == "months").alias("calendar"))


_PERIODS = """
WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS k, o_orderkey % 97 AS x FROM orders),
p AS (SELECT o_orderkey, CASE WHEN k IN (0, 2) THEN 'fixed' WHEN k IN (1, 3) THEN 'months' END AS kind,
  CASE k WHEN 0 THEN x * 3600000 WHEN 1 THEN x WHEN 2 THEN x * 86400000 + 1800000 WHEN 3 THEN -12 * x END AS n FROM o)
SELECT o_orderkey, kind, n::BIGINT AS n, n > 0 AS positive, n = 0 AS zero, kind = 'months' AS calendar FROM p"""


def _names(spark, d):
    """Types, categories and element types of the catalog, written in other cases and with underscores."""
    from ..functions.parse import TYPES

    a = fx.associations(spark, d)
    names = F.element_at(F.array(*map(F.lit, TYPES)), F.col("time_series_type") + 1)
    odd = F.col("owner_id") % 2 == 1
    typed = F.when(odd, F.upper(names)).otherwise(F.lower(F.regexp_replace(names, "(?<=[a-z])(?=[A-Z])", "_")))
    owner = F.when(odd, F.upper("owner_category")).otherwise(F.regexp_replace("owner_category", "lA", "l_a"))
    element = F.element_at(
        F.array(*map(F.lit, ("F64", "tuple(3, f32)", "PiecewiseLinear", "linear_function", "tuple(0,f64)", "f65"))),
        (F.col("owner_id") % 6 + 1).cast("int"),
    )
    rows = a.select("assoc_id", pc.series_type(typed).alias("type"), pc.owner_category(owner).alias("category"), pc.element_type(element).alias("e"))
    return rows.select("assoc_id", "type", "category", "e.kind", "e.dtype", "e.arity")


_NAMES = f"""{_A} SELECT assoc_id, time_series_type AS type, owner_category AS category,
  ['scalar', 'tuple', 'piecewise_linear', 'linear_function', NULL, NULL][owner_id % 6 + 1] AS kind,
  ['f64', 'f32', 'f64', 'f64', NULL, NULL][owner_id % 6 + 1] AS dtype, [0, 3, 0, 0, NULL, NULL][owner_id % 6 + 1]::BIGINT AS arity FROM assoc"""


def _features(spark, d):
    """Cells of line items as feature values: whole numbers, decimals, truths and words."""
    li = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")
    k = F.col("l_linenumber") % 4
    cents = F.round(F.col("l_discount") * 100).cast("int").cast("string")
    text = F.when(k == 0, F.col("l_quantity").cast("int").cast("string")).when(k == 1, F.concat(F.lit("0."), F.lpad(cents, 2, "0")))
    text = text.when(k == 2, F.when(F.col("l_returnflag") == "N", "true").otherwise("false")).otherwise(F.col("l_returnflag"))
    return li.select("l_orderkey", "l_linenumber", pc.feature(text).alias("f")).select(
        "l_orderkey",
        "l_linenumber",
        "f.kind",
        "f.i",
        F.round("f.f", 6).alias("f"),
        "f.b",
        "f.s",
    )


_FEATURES = """
SELECT l_orderkey, l_linenumber, ['int', 'float', 'bool', 'str'][l_linenumber % 4 + 1] AS kind,
  CASE WHEN l_linenumber % 4 = 0 THEN l_quantity::BIGINT END AS i, CASE WHEN l_linenumber % 4 = 1 THEN round(l_discount, 6) END AS f,
  CASE WHEN l_linenumber % 4 = 2 THEN l_returnflag = 'N' END AS b, CASE WHEN l_linenumber % 4 = 3 THEN l_returnflag END AS s FROM lineitem"""


def _feature_classes(spark, d):
    """Series of one features hash, by the first of them; each distinct map is hashed once."""
    a = fx.associations(spark, d)
    entries = F.array_sort(F.map_entries("features"))
    distinct = a.select(entries.alias("entries")).distinct().withColumn("hash", hash_features("entries"))
    rows = a.select("assoc_id", entries.alias("entries")).join(distinct, "entries").select("assoc_id", "hash")
    first = rows.groupBy("hash").agg(F.min("assoc_id").alias("first"), F.max(F.length("hash")).alias("digits"))
    return rows.join(first, "hash").select("assoc_id", "first", F.col("digits").cast("long").alias("digits"))


def _refusals(spark, d):
    """What is said of rows to be added, with faults planted by owner: types, shapes, periods, percentiles, instants."""
    base = _incoming(spark, d)
    k = F.col("owner_id") % 12
    forecast = {4: 2, 5: 2, 6: 4, 7: 5, 8: 2, 9: 4}
    kind = F.col("time_series_type")
    for case, code in forecast.items():
        kind = F.when(k == case, code).otherwise(kind)
    null = lambda t: F.lit(None).cast(t)
    known = k.isin(*[c for c in forecast if c != 4])
    shape = F.when(k == 2, F.array(F.lit(7))).when(k.isin(4, 5, 8), F.array(F.lit(24), F.lit(30)))
    shape = shape.when(k == 6, F.array(F.lit(2), F.lit(12), F.lit(30))).when(
        k.isin(7, 9),
        F.array(F.lit(2), F.lit(12), F.lit(30)),
    ).otherwise(F.col("shape"))
    rows = base.withColumns(
        {
            "time_series_type": F.when(k == 1, 3).otherwise(kind),
            "shape": shape.cast("array<int>"),
            "resolution": F.when(k == 3, F.lit("-PT1H")).when(k == 10, null("string")).otherwise(F.col("resolution")),
            "initial_timestamp": F.when(
                k == 11,
                F.timestamp_add("MICROSECOND", F.lit(1), F.col("initial_timestamp")),
            ).otherwise(F.col("initial_timestamp")),
            "horizon": F.when(known, F.lit("P1D")),
            "interval": F.when(known, F.when(k == 8, F.lit("PT0S")).otherwise(F.lit("P1D"))),
            "count": F.when(known, F.when(k.isin(5, 7), 29).otherwise(30)).cast("long"),
            "percentiles": F.when(k == 9, F.array(F.lit(50.0), F.lit(10.0))).otherwise(F.when(k == 6, F.array(F.lit(5.0)))),
        }
    )
    return Store.problems(_as(rows, INCOMING)).select(*_OWNER, "problem").where("problem is not null")


_REFUSALS = """SELECT DISTINCT owner_id, name, CASE owner_id % 12
  WHEN 1 THEN 'this type cannot be written' WHEN 2 THEN 'the shape does not fit the values' WHEN 3 THEN 'the resolution must be positive'
  WHEN 4 THEN 'horizon, interval and count are needed' WHEN 5 THEN 'the second axis is the count'
  WHEN 6 THEN 'one percentile for each of the first axis is needed' WHEN 7 THEN 'the third axis is the count'
  WHEN 8 THEN 'a zero interval has one window' WHEN 9 THEN 'percentiles must increase'
  WHEN 10 THEN 'initial timestamp and resolution are needed' WHEN 11 THEN 'instants are whole milliseconds' END AS problem
FROM hourly WHERE owner_id % 12 > 0"""


def _added(fixture, ends, schema):
    """Half of the links stored, and the other half added."""

    def query(spark, d):
        rows = _as(fixture(spark, d), schema)
        half = F.col("id") % 2 == 0
        return links.added(rows.where(half), rows.where(~half), ends)

    return query


def _empty(spark, d):
    a = fx.associations(spark, d)
    cases = {"all": a, "scenarios": a.where("time_series_type = 5"), "views": a.where("time_series_type = 3")}
    rows = [(name, catalog.is_empty(df)) for name, df in cases.items()]
    return spark.createDataFrame(rows, "part string, empty boolean")


def _with_metadata(spark, d):
    rows = _store(spark, d).read(ListFilter(time_series_type=0, resolution="PT1H", owner_category="Component"))
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x).cast("long").alias("total")
    return rows.select(
        "owner_id",
        "owner_type",
        "name",
        "initial_timestamp",
        "resolution",
        F.size("values").cast("long").alias("length"),
        F.col("features")["year"]["i"].alias("year"),
        "component_field",
        total,
    )


def _described(spark, d):
    """A file for each event type and one JSON text that describes them all, whose owners come from a table."""
    totals = series.steps(fx.hourly(spark, d), fx.HOUR, ["name"]).groupBy("name", "idx").agg(F.sum("v").alias("v"))
    items, paths = [], {}
    for i, name in enumerate(fx.EVENTS):
        paths[name] = _one_file(totals.where(F.col("name") == name).orderBy("idx").select(F.col("v").alias("value")), _folder(spark, "described"))
        items.append(
            {
                "owner_id": i,
                "owner_type": "Total",
                "name": name,
                "initial_timestamp": "2024-01-01T00:00:00Z",
                "resolution": "PT1H",
                "length": fx.HOURS,
            },
        )
    out = None
    for item in csv_io.descriptor(json.dumps(items), set(typed_csv.KEYS)):
        rows = typed_csv.typed_series(spark, paths[item["name"]], item)
        out = rows if out is None else out.union(rows)
    return series.steps(out, fx.HOUR, _OWNER).select(*_OWNER, "idx", "t", F.col("v").cast("long").alias("v"))


def _owner_map(spark, d):
    """Totals by event type as a wide file, and the owners of its columns from a second file."""
    totals = series.steps(fx.hourly(spark, d), fx.HOUR, ["name"]).groupBy("name", "idx", "t").agg(F.sum("v").alias("v"))
    wide = totals.groupBy("idx", "t").pivot("name", fx.EVENTS).agg(F.first("v")).orderBy("idx")
    path = _one_file(wide.select(wire_instant(F.col("t")).alias("timestamp"), *fx.EVENTS), _folder(spark, "wide"))
    names = spark.createDataFrame([(n, 10 * i, "Kind" + n[0]) for i, n in enumerate(fx.EVENTS)], "column string, owner_id long, owner_type string")
    owners = csv_io.owner_map(spark, _one_file(names, _folder(spark, "owners")))
    back = csv_io.read_wide(spark, path, owners)
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x).cast("long").alias("total")
    return back.select("owner_id", "owner_type", "column", total)


QUERIES = {
    "PER_6_PER_7_period_texts": (_periods, _PERIODS),
    "PER_8_timestamp_texts": (_timestamps, f"SELECT event_id, {_AT} AS t FROM events"),
    "PER_9_range_texts": (_ranges, f"SELECT event_id, {_AT} AS start, TIMESTAMP '2030-01-01' AS \"end\" FROM events"),
    "PER_12_names": (_names, _NAMES),
    "PER_13_feature_texts": (_features, _FEATURES),
    "ARR_2_features_hash_classes": (
        _feature_classes,
        f"{_A} SELECT assoc_id, min(assoc_id) OVER (PARTITION BY year, segment) AS first, 64::BIGINT AS digits FROM assoc",
    ),
    "FCW_10_FCW_11_refusals": (_refusals, f"{_H} {_REFUSALS}"),
    "ASC_1_add_links": (
        _added(fx.attribute_links, links.ATTRIBUTES, ATTRIBUTE_LINKS),
        f"WITH {fx.SQL_LINKS} SELECT id, component_id, component_type, attribute_id, attribute_type FROM links",
    ),
    "ASC_10_add_edges": (
        _added(fx.component_edges, links.EDGES, COMPONENT_EDGES),
        f"WITH {fx.SQL_EDGES} SELECT id, parent_id, parent_type, child_id, child_type FROM edges",
    ),
    "KEY_4_is_empty": (
        _empty,
        f"{_A} SELECT 'all' AS part, count(*) = 0 AS empty FROM assoc UNION ALL SELECT 'scenarios', count(*) = 0 FROM assoc WHERE time_series_type = 5 UNION ALL SELECT 'views', count(*) = 0 FROM assoc WHERE time_series_type = 3",
    ),
    "SLC_4_series_with_metadata": (
        _with_metadata,
        f"""{_A}, {fx.SQL_HOURLY} SELECT owner_id, owner_type, name, initial_timestamp, resolution, count(*) AS length, year, component_field, sum(v)::BIGINT AS total
FROM assoc JOIN hourly USING (owner_id, name) WHERE time_series_type = 0 AND owner_category = 'Component' GROUP BY ALL""",
    ),
    "SRC_22_descriptor": (
        _described,
        f"{_H} SELECT list_position({fx.EVENTS}, name)::BIGINT - 1 AS owner_id, name, idx, any_value(t) AS t, sum(v)::BIGINT AS v FROM hourly GROUP BY name, idx",
    ),
    "SRC_21_owner_map": (
        _owner_map,
        f"{_H} SELECT 10 * (list_position({fx.EVENTS}, name)::BIGINT - 1) AS owner_id, 'Kind' || name[1] AS owner_type, name AS \"column\", sum(v)::BIGINT AS total FROM hourly GROUP BY name",
    ),
}
