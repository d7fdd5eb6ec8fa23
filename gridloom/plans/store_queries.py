"""Queries that go through the store, its readers and its files."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from ..functions.hashing import array_hash_column, decoded_timestamps, encoded_timestamps, timestamps_hash_column
from ..functions.period import Period
from ..functions.tables import shared_folder
from ..operators import readers, series
from ..operators.filters import ListFilter
from ..schema import TABLES
from ..sources import csv_io
from ..sources.store import INCOMING, Store
from . import fixtures as fx

HOUR = Period.parse("PT1H")
_OWNER = ["owner_id", "name"]
_START, _END = dt.datetime(2024, 1, 5, 6, 30), dt.datetime(2024, 1, 7, 0, 15)


def _as(df, schema: str):
    """df with the columns of a schema, null where it has none."""
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in _parse_datatype_string(schema)],
    )


def _key(prefix: str, *columns: str):
    return F.sha2(F.concat(F.lit(prefix), *[x for c in columns for x in (F.lit(":"), F.col(c).cast("string"))][1:]), 256)


def _store(spark, d) -> Store:
    """A store in memory of the fixtures' catalog, arrays of its single series and timestamp vectors."""
    hourly = fx.hourly(spark, d).select(
        _key("ts:", *_OWNER).alias("data_hash"),
        F.lit("f64").alias("dtype"),
        F.array("length").cast("array<int>").alias("shape"),
        F.col("values").cast("array<double>").alias("values"),
    )
    axes = fx.irregular(spark, d).select(_key("axis:", "owner_id").alias("timestamps_hash"), "timestamps")
    empty = {k: spark.createDataFrame([], s) for k, s in TABLES.items()}
    own = {"associations": fx.associations(spark, d), "arrays": hourly, "timestamp_sets": axes}
    return Store(spark, empty | {k: _as(v, TABLES[k]) for k, v in own.items()})


def _after(change, columns: list[str]):
    """The catalog after a change."""

    def query(spark, d):
        store = _store(spark, d)
        change(store)
        return store.associations.select(*columns)

    return query


def _stored_arrays(spark, d):
    """The hourly series as if read from a table: what makes them is not evaluated inside the hash function's stage."""
    return fx.hourly(spark, d).repartition(*_OWNER)


def _incoming(spark, d):
    rows = _stored_arrays(spark, d).withColumns(
        {
            "owner_type": F.lit("Generator"),
            "owner_category": F.lit("Component"),
            "time_series_type": F.lit(0),
            "resolution": F.lit("PT1H"),
            "element_type": F.lit("f64"),
            "shape": F.array("length"),
            "features": F.create_map(),
        },
    )
    return _as(rows.withColumn("values", F.col("values").cast("array<double>")), INCOMING)


def _on_disk(spark, d) -> Store:
    """All hourly series added to a store in the shared folder, and the store opened anew."""
    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    Store.create(spark, path).add_frame(_incoming(spark, d))
    return Store.open(spark, path)


def _steps(rows):
    return series.steps(rows, HOUR, _OWNER).select(*_OWNER, "idx", "t", F.col("v").cast("long").alias("v"))


def _read_back(spark, d):
    return _steps(_on_disk(spark, d).read(ListFilter(time_series_type=0)))


def _replaced(spark, d):
    """Series of owner 3 added again with every value one larger."""
    store = Store.create(spark)
    first = _incoming(spark, d)
    store.add_frame(first)
    store.add_frame(first.where("owner_id = 3").withColumn("values", F.transform("values", lambda x: x + 1)), replace=True)
    return _steps(store.read(ListFilter()))


def _shared(spark, d):
    """Each series stored for two owners: how many series an array has."""
    store = Store.create(spark)
    first = _incoming(spark, d)
    store.add_frame(first.unionByName(first.withColumn("owner_id", F.col("owner_id") + 1_000_000)))
    arrays = store.associations.groupBy("data_hash").agg(F.min(F.struct("owner_id", "name")).alias("first"), F.count(F.lit(1)).alias("series"))
    return arrays.join(store.tables["arrays"].select("data_hash"), "data_hash").select("first.owner_id", "first.name", "series")


def _classes(spark, d):
    """Series of equal content hash, by the first of them."""
    rows = _stored_arrays(spark, d)
    hashed = rows.select(*_OWNER, array_hash_column("i64", F.array("length"), F.col("values")).alias("h"))
    first = hashed.groupBy("h").agg(F.min(F.struct(*_OWNER)).alias("first"))
    return hashed.join(first, "h").select(*_OWNER, F.col("first.owner_id").alias("first_owner"), F.col("first.name").alias("first_name"))


def _vector_classes(spark, d):
    hashed = fx.irregular(spark, d).select("owner_id", timestamps_hash_column(F.col("timestamps")).alias("h"))
    first = hashed.groupBy("h").agg(F.min("owner_id").alias("first_owner"))
    return hashed.join(first, "h").select("owner_id", "first_owner")


def _decoded(spark, d):
    blobs = fx.irregular(spark, d).select("owner_id", encoded_timestamps(F.col("timestamps")).alias("blob"))
    return blobs.select("owner_id", F.explode(decoded_timestamps(F.col("blob"))).alias("t"))


def _range(spark, d):
    keys = spark.createDataFrame([(0, 3, "view"), (1, 5, "click"), (2, 3, "view")], "ordinal long, owner_id long, name string")
    cut = _store(spark, d).read_range(keys, _OWNER, _START, _END)
    return series.steps(cut, HOUR, ["ordinal", *_OWNER]).select("ordinal", *_OWNER, "idx", "t", F.col("v").cast("long").alias("v"))


def _static(spark, d):
    s = _store(spark, d)
    rows = readers.static_reader(s.associations, s.tables["arrays"], ListFilter(resolution="PT1H"))
    return readers.static_sweep(rows, HOUR, _OWNER).select("t", *_OWNER, F.col("v").cast("long").alias("v"))


def _forecasts(spark, d):
    s = _store(spark, d)
    out = readers.forecast_reader(s.associations, s.tables["arrays"], ListFilter(time_series_type=3), _OWNER, dt.datetime(2024, 1, 21))
    return out.select(*_OWNER, "w", "h", F.col("v").cast("long").alias("v"), "issue_time", "target_time")


def _rows_of_json(spark, d):
    back = csv_io.row_json(
        csv_io.wire_series(
            fx.associations(spark, d).withColumns(
                {
                    c: F.lit(None).cast(t) for c,
                    t in (
                        ("units", "string"),
                        ("quantity_kind", "string"),
                        ("unit_system", "string"),
                        ("percentiles", "array<double>"),
                        ("application_data", "string"),
                    )
                },
            ),
        ),
    )
    return back.select(
        "owner_id",
        "owner_type",
        "name",
        "initial_timestamp",
        "resolution",
        "length",
        "horizon",
        "interval",
        "count",
        "component_field",
        "data_hash",
        F.col("features")["year"].alias("year"),
        F.col("features")["segment"].alias("segment"),
    )


def _of(fn):
    return lambda spark, d: fn(_store(spark, d))


_A = f"WITH {fx.SQL_ASSOC}"
_H = f"WITH {fx.SQL_HOURLY}"
_VIEW_KEY = ListFilter(owner_id=3, time_series_type=0, exact_type=True, name="view")
_CLICKS = ListFilter(owner_id=4, time_series_type=3, exact_type=True, name="click")
_STEPS = "SELECT owner_id, name, idx, t, v FROM hourly"

QUERIES = {
    "DML_2_add_read_back": (_read_back, f"{_H} {_STEPS}"),
    "DML_7_remove": (
        _after(lambda s: s.remove(_CLICKS, at_least=0), ["assoc_id"]),
        f"{_A} SELECT assoc_id FROM assoc WHERE NOT (owner_id = 4 AND time_series_type = 3 AND name = 'click')",
    ),
    "DML_8_remove_each": (
        _after(lambda s: s.remove_each([ListFilter(owner_id=5, time_series_type=0, exact_type=True, name="click"), _VIEW_KEY]), ["assoc_id"]),
        f"{_A} SELECT assoc_id FROM assoc WHERE NOT (time_series_type = 0 AND ((owner_id = 5 AND name = 'click') OR (owner_id = 3 AND name = 'view')))",
    ),
    "DML_9_remove_by_filter": (
        _after(lambda s: s.remove(ListFilter(name_glob="*i*", component_field="max_active_power")), ["assoc_id"]),
        f"{_A} SELECT assoc_id FROM assoc WHERE NOT coalesce(name GLOB '*i*' AND component_field = 'max_active_power', false)",
    ),
    "DML_11_rename": (
        _after(lambda s: s.rename(_VIEW_KEY, "seen"), ["assoc_id", "name"]),
        f"{_A} SELECT assoc_id, CASE WHEN owner_id = 3 AND time_series_type = 0 AND name = 'view' THEN 'seen' ELSE name END AS name FROM assoc",
    ),
    "DML_12_copy": (
        _after(lambda s: s.copy(_VIEW_KEY, 888_888, "Load"), ["owner_id", "owner_type", "name", "data_hash"]),
        f"{_A} SELECT owner_id, owner_type, name, data_hash FROM assoc UNION ALL SELECT 888888, 'Load', name, data_hash FROM assoc WHERE owner_id = 3 AND time_series_type = 0 AND name = 'view'",
    ),
    "DML_13_replace_owner": (
        _after(lambda s: s.replace_owner(3, 999_999), ["assoc_id", "owner_id", "owner_type"]),
        f"{_A} SELECT assoc_id, CASE WHEN owner_id = 3 AND owner_category = 'Component' THEN 999999 ELSE owner_id END AS owner_id, owner_type FROM assoc",
    ),
    "DML_10_clear_owner": (
        _after(lambda s: s.clear(3, "Component"), ["assoc_id"]),
        f"{_A} SELECT assoc_id FROM assoc WHERE NOT (owner_id = 3 AND owner_category = 'Component')",
    ),
    "SET_3_add_replace": (_replaced, f"{_H} SELECT owner_id, name, idx, t, v + (owner_id = 3)::BIGINT AS v FROM hourly"),
    "DML_1_arrays_once": (
        _shared,
        f"{_H}, g AS (SELECT owner_id, name, list(v ORDER BY idx) AS a FROM hourly GROUP BY ALL) SELECT min((owner_id, name)).owner_id AS owner_id, min((owner_id, name)).name AS name, 2 * count(*) AS series FROM (SELECT {{'owner_id': owner_id, 'name': name}} AS k, * FROM g) GROUP BY a".replace(
            "min((owner_id, name))",
            "min(k)",
        ),
    ),
    "SRC_14_array_by_hash": (
        _of(lambda s: s.array(
            s.spark.range(1).select(F.sha2(F.lit("ts:5:click"), 256)).first()[0],
        ).select(F.posexplode("values").alias("idx", "v")).select(
            F.col("idx").cast("long").alias("idx"),
            F.col("v").cast("long").alias("v"),
        )),
        f"{_H} SELECT idx, v FROM hourly WHERE owner_id = 5 AND name = 'click'",
    ),
    "SRC_12_array_shapes": (
        _of(lambda s: s.array_shapes().select("data_hash", "dtype", F.element_at("shape", 1).cast("long").alias("length"))),
        f"{_H} SELECT sha256('ts:' || owner_id || ':' || name) AS data_hash, 'f64' AS dtype, count(*) AS length FROM hourly GROUP BY owner_id, name",
    ),
    "LST_12_timestamps": (
        _of(lambda s: s.timestamps(s.spark.range(1).select(F.sha2(F.lit("axis:5"), 256)).first()[0]).select("t")),
        f"WITH {fx.SQL_IRREGULAR} SELECT t FROM activity WHERE owner_id = 5",
    ),
    "JON_2_hydration": (
        _of(lambda s: s.list(ListFilter(time_series_type=1)).select("owner_id", "name", F.explode("timestamps").alias("t"))),
        f"WITH {fx.SQL_IRREGULAR} SELECT owner_id, 'activity' AS name, t FROM activity",
    ),
    "JON_3_arrays": (
        _of(lambda s: s.read(ListFilter(time_series_type=0, resolution="PT1H")).select(
            "assoc_id",
            F.aggregate("values", F.lit(0.0), lambda a, x: a + x).cast("long").alias("total"),
        )),
        f"{_A}, {fx.SQL_HOURLY} SELECT assoc_id, sum(v)::BIGINT AS total FROM assoc JOIN hourly USING (owner_id, name) WHERE time_series_type = 0 GROUP BY 1",
    ),
    "SLC_6_bulk_range": (
        _range,
        f"{_H} SELECT k.ordinal::BIGINT AS ordinal, owner_id, name, idx - 102 AS idx, t, v FROM hourly JOIN (VALUES (0, 3, 'view'), (1, 5, 'click'), (2, 3, 'view')) k(ordinal, o, n) ON owner_id = o AND name = n WHERE idx >= 102 AND idx < 145",
    ),
    "RDR_1_static_reader": (_static, f"{_H} SELECT t, owner_id, name, v FROM hourly"),
    "RDR_4_forecast_reader": (
        _forecasts,
        f"{_H} SELECT h.owner_id, h.name, 20::BIGINT AS w, (h.idx - 480)::BIGINT AS h, h.v, TIMESTAMP '2024-01-21' AS issue_time, h.t AS target_time FROM hourly h WHERE owner_id % 2 = 0 AND idx >= 480 AND idx < 528",
    ),
    "SRC_24_row_json": (
        _rows_of_json,
        f"{_A} SELECT owner_id, owner_type, name, initial_timestamp, resolution, length::BIGINT AS length, horizon, \"interval\", \"count\"::BIGINT AS \"count\", component_field, data_hash, year::VARCHAR AS year, segment FROM assoc",
    ),
    "SNK_3_json_lines": (
        (lambda spark, d: csv_io.json_lines(fx.hourly(spark, d), HOUR, _OWNER)),
        f"{_H} SELECT owner_id, name, idx, '{{\"timestamp\":\"' || strftime(t, '%Y-%m-%dT%H:%M:%SZ') || '\",\"value\":' || v || '}}' AS json FROM hourly",
    ),
    "PER_11_timestamp_codec": (_decoded, f"WITH {fx.SQL_IRREGULAR} SELECT owner_id, t FROM activity"),
    "ARR_1_hash_classes": (
        _classes,
        f"{_H}, g AS (SELECT owner_id, name, list(v ORDER BY idx) AS a FROM hourly GROUP BY ALL), k AS (SELECT *, min({{'o': owner_id, 'n': name}}) OVER (PARTITION BY a) AS f FROM g) SELECT owner_id, name, f.o AS first_owner, f.n AS first_name FROM k",
    ),
    "ARR_3_hash_classes": (
        _vector_classes,
        f"WITH {fx.SQL_IRREGULAR}, g AS (SELECT owner_id, list(t ORDER BY t) AS a FROM activity GROUP BY 1) SELECT owner_id, min(owner_id) OVER (PARTITION BY a) AS first_owner FROM g",
    ),
}
