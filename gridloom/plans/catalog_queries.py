"""Filters, listing, lookups, counts, guards, links, set operations and edits of the catalog."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.period import Period, instant, iso_of, wire_instant
from ..operators import catalog, links, readers, series, sets
from ..operators.filters import ListFilter
from . import fixtures as fx

#: Catalog columns that both engines show.
COLS = [
    "assoc_id",
    "owner_id",
    "owner_type",
    "owner_category",
    "time_series_type",
    "name",
    "initial_timestamp",
    "resolution",
    "length",
    "horizon",
    "interval",
    "count",
    "component_field",
    "features_hash",
    "data_hash",
]
_ID = ["owner_id", "owner_category", "time_series_type", "name", "resolution", "interval", "features_hash"]
_SQL_COLS = ", ".join(f'"{c}"' + ("::BIGINT AS " + f'"{c}"' if c in ("length", "count") else "") for c in COLS)
_SQL_ID = ", ".join(f'"{c}"' for c in _ID)


def _assoc(fn):
    return lambda spark, d: fn(fx.associations(spark, d))


def _filter(f: ListFilter, where: str):
    return _assoc(lambda a: f.of(a).select(*COLS)), f"WITH {fx.SQL_ASSOC} SELECT {_SQL_COLS} FROM assoc WHERE {where}"


def _q(fn, sql: str):
    return _assoc(fn), f"WITH {fx.SQL_ASSOC} {sql}"


def _links(fn, sql: str):
    return (lambda spark, d: fn(fx.attribute_links(spark, d))), f"WITH {fx.SQL_LINKS} {sql}"


def _edges(fn, sql: str):
    return (lambda spark, d: fn(fx.component_edges(spark, d))), f"WITH {fx.SQL_EDGES} {sql}"


def _changed(a):
    """A second catalog: without owners 3 and 8, with other arrays for owner 5 and one more owner."""
    other = a.where(~F.col("owner_id").isin(3, 8)).withColumn(
        "data_hash",
        F.when(F.col("owner_id") == 5, F.sha2(F.col("data_hash"), 256)).otherwise(F.col("data_hash")),
    )
    more = a.where(F.col("owner_id") == 1).withColumn("owner_id", F.lit(777_777).cast("long"))
    return other.unionByName(more)


_CHANGED = """changed AS (SELECT * REPLACE (CASE WHEN owner_id = 5 THEN sha256(data_hash) ELSE data_hash END AS data_hash) FROM assoc WHERE owner_id NOT IN (3, 8)
UNION ALL SELECT * REPLACE (777777 AS owner_id) FROM assoc WHERE owner_id = 1)"""
_SAME = " AND ".join(f'l."{c}" IS NOT DISTINCT FROM r."{c}"' for c in _ID)


def _transform(a):
    single = a.where(F.col("time_series_type") != 2).where("owner_id < 1000000")
    out = series.transform(single, Period.parse("P2D"), Period.parse("P1D"), resolution="PT1H")
    return out.select(*_ID, "horizon", F.col("count").cast("long").alias("count"), "data_hash")


def _family(a):
    """Views asked for where dense forecasts stand already."""
    new = a.where("time_series_type = 0 and owner_id < 1000000").withColumn("time_series_type", F.lit(3))
    return sets.family_conflicts(new, a).select("owner_id", "owner_category", "name")


def _owner_move(a):
    """Conflicts of the family rule if the views of owner 2 went to owner 1, both with the features of owner 1."""
    one = a.where("owner_id = 1").agg(F.first("features_hash").alias("h")).first()["h"]
    return sets.owner_move_conflicts(a.withColumn("features_hash", F.lit(one)), 2, 1).select("owner_id", "name")


def _resolved(a):
    row = catalog.resolve_forecast(
        a,
        ListFilter(owner_id=6, owner_category="Component", name="click", time_series_type=2, features={"year": 2024, "segment": "b"}),
    )
    return a.where(F.col("assoc_id") == row["assoc_id"]).select(*COLS)


def _periods(a):
    kinds = F.when(F.col("resolution") == "P1M", F.lit("months")).otherwise(F.lit("fixed"))
    n = F.when(kinds == "months", F.col("owner_id") % 30).otherwise(F.col("owner_id") * 1_234_567)
    return a.where("time_series_type = 0").select("assoc_id", iso_of(kinds, n).alias("iso"))


_KEY = ListFilter(
    owner_id=7,
    owner_category="Component",
    time_series_type=0,
    exact_type=True,
    name="view",
    resolution="PT1H",
    features={"year": 2025, "segment": "c"},
)


def _bulk(a):
    spark = a.sparkSession
    keys = spark.createDataFrame([(0, 3, "view"), (1, 1, "click"), (2, 3, "view")], "ordinal long, owner_id long, name string")
    rows = catalog.metadata_of(a.where("time_series_type = 0"), keys, ["owner_id", "name"])
    return rows.select("ordinal", "owner_id", "name", "data_hash")


QUERIES = {
    "FLT_1_owner_id": _filter(ListFilter(owner_id=5), "owner_id = 5"),
    "FLT_2_owner_category": _filter(ListFilter(owner_category="SupplementalAttribute"), "owner_category = 'SupplementalAttribute'"),
    "FLT_3_owner_type": _filter(ListFilter(owner_type="Load"), "owner_type = 'Load'"),
    "FLT_4_type_widening": _filter(ListFilter(time_series_type=2), "time_series_type BETWEEN 2 AND 3"),
    "FLT_5_type_exact": _filter(ListFilter(time_series_type=2, exact_type=True), "time_series_type = 2"),
    "FLT_7_name": _filter(ListFilter(name="click"), "name = 'click'"),
    "FLT_8_name_glob": _filter(ListFilter(name_glob="[^a-c]*i[eg]?*"), "name GLOB '[!a-c]*i[eg]?*'"),
    "FLT_9_component_field": _filter(ListFilter(component_field="max_active_power"), "component_field = 'max_active_power'"),
    "FLT_10_resolution_interval": _filter(ListFilter(resolution="PT1H", interval="P1D"), "resolution = 'PT1H' AND \"interval\" = 'P1D'"),
    "FLT_11_features_subset": _filter(ListFilter(features={"year": 2025}), "year = 2025"),
    "FLT_12_features_exact": (
        _assoc(lambda a: ListFilter(features={"year": 2024, "segment": "a"}).of(a).where(F.size("features") == 2).select(*COLS)),
        f"WITH {fx.SQL_ASSOC} SELECT {_SQL_COLS} FROM assoc WHERE year = 2024 AND segment = 'a'",
    ),
    "FLT_13_all_conditions": _filter(
        ListFilter(owner_category="Component", owner_type="Generator", time_series_type=0, name_glob="*i*", features={"segment": "b"}),
        "owner_category = 'Component' AND owner_type = 'Generator' AND time_series_type = 0 AND name GLOB '*i*' AND segment = 'b'",
    ),
    "FLT_14_endpoint_types": _links(
        lambda t: links.listed(t, first={"types": ["Supplier1"]}, second={"types": ["Part0", "Part2"]}).select("component_id", "attribute_id"),
        "SELECT component_id, attribute_id FROM links WHERE component_type IN ('Supplier1') AND attribute_type IN ('Part0', 'Part2')",
    ),
    "FLT_14_empty_type_list": _links(
        lambda t: links.listed(t, first={"types": []}).select("component_id", "attribute_id"),
        "SELECT component_id, attribute_id FROM links WHERE false",
    ),
    "FLT_15_hash_prefix": _filter(ListFilter(data_hash="A"), "starts_with(data_hash, 'a')"),
    "LST_1_list_series": _q(
        lambda a: catalog.list_series(a).select(
            *COLS,
            F.col("features")["year"]["i"].alias("year"),
            F.col("features")["segment"]["s"].alias("segment"),
        ),
        f"SELECT {_SQL_COLS}, year, segment FROM assoc",
    ),
    "LST_2_list_keys": _q(
        lambda a: catalog.list_keys(a, ListFilter(time_series_type=0)).drop("features"),
        'SELECT owner_id, owner_type, owner_category, time_series_type, name, resolution, "interval", initial_timestamp, length::BIGINT AS length, horizon, "count"::BIGINT AS "count" FROM assoc WHERE time_series_type = 0',
    ),
    "LST_3_list_keys_with_hash": _q(
        lambda a: catalog.list_keys(a, ListFilter(time_series_type=1), with_hash=True).select("owner_id", "name", "data_hash"),
        "SELECT owner_id, name, data_hash FROM assoc WHERE time_series_type = 1",
    ),
    "LST_4_keys_of_owner": _q(
        lambda a: catalog.list_keys(a, ListFilter(owner_id=4, owner_category="SupplementalAttribute")).select("time_series_type", "name"),
        "SELECT time_series_type, name FROM assoc WHERE owner_id = 4 AND owner_category = 'SupplementalAttribute'",
    ),
    "LST_5_names": _q(
        lambda a: catalog.distinct(a, "name", ListFilter(owner_type="Load")),
        "SELECT DISTINCT name FROM assoc WHERE owner_type = 'Load' ORDER BY name",
    ),
    "LST_6_owner_types": _q(lambda a: catalog.distinct(a, "owner_type"), "SELECT DISTINCT owner_type FROM assoc ORDER BY 1"),
    "LST_7_owner_ids": _q(
        lambda a: catalog.owner_ids(a, "Component", 2, "PT1H"),
        "SELECT DISTINCT owner_id FROM assoc WHERE owner_category = 'Component' AND time_series_type BETWEEN 2 AND 3 AND resolution = 'PT1H'",
    ),
    "LST_8_resolutions": _q(
        lambda a: catalog.distinct(a, "resolution"),
        "SELECT DISTINCT resolution FROM assoc WHERE resolution IS NOT NULL ORDER BY 1",
    ),
    "LST_9_intervals": _q(lambda a: catalog.distinct(a, "interval"), 'SELECT DISTINCT "interval" FROM assoc WHERE "interval" IS NOT NULL ORDER BY 1'),
    "LST_10_identities": _q(lambda a: catalog.identities(a, 3), f"SELECT {_SQL_ID}, horizon FROM assoc WHERE time_series_type = 3"),
    "LST_11_timeline_cohorts": _q(
        lambda a: catalog.timeline_cohorts(a),
        "SELECT timestamps_hash, count(*) AS series FROM assoc WHERE timestamps_hash IS NOT NULL GROUP BY 1",
    ),
    "LST_13_metadata_bulk": _q(
        _bulk,
        "SELECT k.ordinal::BIGINT AS ordinal, a.owner_id, a.name, a.data_hash FROM (VALUES (0, 3, 'view'), (1, 1, 'click'), (2, 3, 'view')) k(ordinal, o, n) JOIN assoc a ON a.owner_id = k.o AND a.name = k.n AND a.time_series_type = 0",
    ),
    "LST_15_array_groups": _q(
        lambda a: catalog.array_groups(a).select(
            "data_hash",
            "series",
            F.array_join(F.transform("assoc_ids", lambda x: x.cast("string")), ",").alias("assoc_ids"),
        ),
        "SELECT data_hash, count(*) AS series, string_agg(assoc_id::VARCHAR, ',' ORDER BY assoc_id) AS assoc_ids FROM assoc GROUP BY 1",
    ),
    "LST_16_referenced_arrays": _q(lambda a: catalog.referenced_arrays(a), "SELECT DISTINCT data_hash, 'f64' AS element_type FROM assoc"),
    "LST_17_list_limit": _q(
        lambda a: catalog.first_listed(a, 50).select("assoc_id", "name"),
        "SELECT assoc_id, name FROM assoc ORDER BY assoc_id LIMIT 50",
    ),
    "KEY_1_get_by_key": _q(
        lambda a: catalog.by_key(a, _KEY).select(*COLS),
        f"SELECT {_SQL_COLS} FROM assoc WHERE owner_id = 7 AND owner_category = 'Component' AND time_series_type = 0 AND name = 'view' AND resolution = 'PT1H' AND year = 2025 AND segment = 'c'",
    ),
    "KEY_2_has_key": _q(
        lambda a: catalog.found(a, ListFilter(owner_id=7, time_series_type=0, exact_type=True, name="view")),
        "SELECT count(*) > 0 AS found FROM assoc WHERE owner_id = 7 AND time_series_type = 0 AND name = 'view'",
    ),
    "KEY_3_has_any": _q(
        lambda a: catalog.found(a, ListFilter(name_glob="zz*", features={"segment": "a"})),
        "SELECT count(*) > 0 AS found FROM assoc WHERE name GLOB 'zz*' AND segment = 'a'",
    ),
    "KEY_5_resolve_forecast": _q(
        _resolved,
        f"SELECT {_SQL_COLS} FROM assoc WHERE owner_id = 6 AND owner_category = 'Component' AND name = 'click' AND time_series_type IN (2, 3) AND year = 2024 AND segment = 'b'",
    ),
    "KEY_6_array_references": _q(
        lambda a: catalog.array_references(a),
        "SELECT data_hash, count(*) FILTER (WHERE time_series_type = 0) AS static_refs, count(*) FILTER (WHERE time_series_type = 3) AS derived_refs FROM assoc GROUP BY 1",
    ),
    "AGG_1_count_by_type": _q(lambda a: catalog.count_of_type(a, 2), "SELECT count(*) AS series FROM assoc WHERE time_series_type = 2"),
    "AGG_2_counts_by_type": _q(catalog.counts_by_type, "SELECT time_series_type, count(*) AS series FROM assoc GROUP BY 1 ORDER BY 1"),
    "AGG_3_store_counts": _q(
        catalog.store_counts,
        "SELECT count(DISTINCT (owner_id, owner_category)) AS owners, count(*) FILTER (WHERE time_series_type <= 1) AS static, count(*) FILTER (WHERE time_series_type > 1) AS forecasts FROM assoc",
    ),
    "AGG_4_detailed_counts": _q(
        catalog.detailed_counts,
        "SELECT count(DISTINCT owner_id) FILTER (WHERE owner_category = 'Component') AS components, count(DISTINCT owner_id) FILTER (WHERE owner_category <> 'Component') AS attributes, count(DISTINCT data_hash) FILTER (WHERE time_series_type <= 1) AS static_arrays, count(DISTINCT data_hash) FILTER (WHERE time_series_type > 1) AS forecast_arrays FROM assoc",
    ),
    "AGG_5_distinct_arrays": _q(catalog.distinct_arrays, "SELECT count(DISTINCT data_hash) AS arrays FROM assoc"),
    "AGG_6_static_summary": _q(
        catalog.static_summary,
        "SELECT owner_type, owner_category, time_series_type, name, initial_timestamp, resolution, length::BIGINT AS length, count(*) AS series FROM assoc WHERE time_series_type <= 1 GROUP BY ALL",
    ),
    "AGG_7_forecast_summary": _q(
        catalog.forecast_summary,
        'SELECT owner_type, owner_category, time_series_type, name, initial_timestamp, resolution, horizon, "interval", "count"::BIGINT AS "count", count(*) AS series FROM assoc WHERE time_series_type > 1 GROUP BY ALL',
    ),
    "AGG_8_static_grids": _q(
        catalog.static_grids,
        "SELECT DISTINCT resolution, initial_timestamp, length::BIGINT AS length FROM assoc WHERE time_series_type = 0 ORDER BY ALL",
    ),
    "AGG_9_static_consistency": _q(
        catalog.static_consistency,
        "SELECT resolution, min(initial_timestamp) AS initial_timestamp, min(length)::BIGINT AS length, count(DISTINCT (initial_timestamp, length)) AS grids FROM assoc WHERE time_series_type = 0 GROUP BY 1",
    ),
    "AGG_10_forecast_parameters": _q(
        catalog.forecast_parameters,
        'SELECT horizon, "interval", "count"::BIGINT AS "count", resolution, initial_timestamp FROM assoc WHERE time_series_type > 1 ORDER BY time_series_type, assoc_id LIMIT 1',
    ),
    "AGG_12_store_stats": _q(
        lambda a: catalog.store_counts(a).crossJoin(F.broadcast(catalog.distinct_arrays(a))),
        "SELECT count(DISTINCT (owner_id, owner_category)) AS owners, count(*) FILTER (WHERE time_series_type <= 1) AS static, count(*) FILTER (WHERE time_series_type > 1) AS forecasts, count(DISTINCT data_hash) AS arrays FROM assoc",
    ),
    "JON_4_family_conflicts": _q(
        _family,
        "SELECT owner_id, owner_category, name FROM assoc n WHERE time_series_type = 0 AND owner_id < 1000000 AND EXISTS (SELECT 1 FROM assoc a WHERE a.time_series_type = 2 AND a.owner_id = n.owner_id AND a.owner_category = n.owner_category AND a.name = n.name AND a.resolution IS NOT DISTINCT FROM n.resolution AND a.features_hash = n.features_hash)",
    ),
    "JON_5_owner_move": _q(
        _owner_move,
        "SELECT 1::BIGINT AS owner_id, m.name FROM assoc m JOIN assoc x ON x.owner_id = 1 AND x.name = m.name AND x.resolution IS NOT DISTINCT FROM m.resolution AND x.time_series_type = CASE m.time_series_type WHEN 2 THEN 3 WHEN 3 THEN 2 END WHERE m.owner_id = 2",
    ),
    "JON_6_orphaned_vectors": _q(
        lambda a: sets.orphans(a.where("time_series_type = 1").select("timestamps_hash"), a.where("owner_id % 3 <> 0"), "timestamps_hash"),
        "SELECT timestamps_hash FROM assoc WHERE time_series_type = 1 AND timestamps_hash NOT IN (SELECT timestamps_hash FROM assoc WHERE owner_id % 3 <> 0 AND timestamps_hash IS NOT NULL)",
    ),
    "JON_7_orphaned_views": _q(
        lambda a: sets.orphaned_views(a.where("not (time_series_type = 0 and owner_id % 6 = 0)")),
        "SELECT data_hash FROM assoc WHERE NOT (time_series_type = 0 AND owner_id % 6 = 0) GROUP BY 1 HAVING count(*) FILTER (WHERE time_series_type = 3) > 0 AND count(*) FILTER (WHERE time_series_type = 0) = 0",
    ),
    "JON_8_unreferenced_arrays": _q(
        lambda a: sets.orphans(a.select("data_hash").distinct(), a.where("owner_id <> 9"), "data_hash"),
        "SELECT DISTINCT data_hash FROM assoc WHERE data_hash NOT IN (SELECT data_hash FROM assoc WHERE owner_id <> 9)",
    ),
    "SET_1_diff": _q(lambda a: sets.diff(a, _changed(a)), f""", {_CHANGED} SELECT {', '.join(f'coalesce(l."{c}", r."{c}") AS "{c}"' for c in _ID)}, CASE WHEN l.data_hash IS NULL THEN 'added' WHEN r.data_hash IS NULL THEN 'removed' ELSE 'changed' END AS status
        FROM assoc l FULL JOIN changed r ON {_SAME} WHERE l.data_hash IS DISTINCT FROM r.data_hash"""),
    "SET_4_content_dedup": _q(
        lambda a: sets.deduplicated(a.select("data_hash"), a.where("owner_id % 5 = 0").select("data_hash").distinct()),
        "SELECT DISTINCT data_hash FROM assoc WHERE data_hash NOT IN (SELECT data_hash FROM assoc WHERE owner_id % 5 = 0)",
    ),
    "FCW_8_transform": _q(_transform, f"""SELECT {', '.join(f"'P1D' AS \"interval\"" if c == "interval" else "3 AS time_series_type" if c == "time_series_type" else f'"{c}"' for c in _ID)}, 'P2D' AS horizon, 29::BIGINT AS "count", data_hash FROM assoc n
        WHERE time_series_type = 0 AND resolution = 'PT1H' AND NOT EXISTS (SELECT 1 FROM assoc a WHERE a.time_series_type = 3 AND a.owner_id = n.owner_id AND a.name = n.name)"""),
    "RDR_2_column_order": _q(
        lambda a: readers.columns_of(ListFilter(time_series_type=0, resolution="PT1H").of(a)).select("owner_id", "name"),
        "SELECT owner_id, name FROM assoc WHERE time_series_type = 0 AND resolution = 'PT1H' ORDER BY owner_id, owner_category, name",
    ),
    "RDR_6_slots": _q(
        lambda a: readers.slots(a.where("time_series_type > 1")).withColumn("count", F.col("count").cast("long")),
        "SELECT DISTINCT data_hash, 'f64' AS element_type, time_series_type, horizon, \"interval\", \"count\"::BIGINT AS \"count\" FROM assoc WHERE time_series_type > 1",
    ),
    "SRT_2_typed_order": _q(
        lambda a: a.orderBy(*catalog.typed_order()).select("assoc_id"),
        'SELECT assoc_id FROM assoc ORDER BY owner_id, owner_category, time_series_type, name, coalesce(resolution, \'\'), coalesce("interval", \'\')',
    ),
    "PER_5_iso_text": _q(_periods, """SELECT assoc_id, CASE WHEN n = 0 THEN 'PT0S' WHEN resolution = 'P1M' THEN CASE WHEN n % 12 = 0 THEN 'P' || n // 12 || 'Y' ELSE 'P' || n || 'M' END ELSE
        'P' || CASE WHEN n // 86400000 > 0 THEN n // 86400000 || 'D' ELSE '' END || CASE WHEN n % 86400000 = 0 THEN '' ELSE 'T' || CASE WHEN n % 86400000 // 3600000 > 0 THEN n % 86400000 // 3600000 || 'H' ELSE '' END
        || CASE WHEN n % 3600000 // 60000 > 0 THEN n % 3600000 // 60000 || 'M' ELSE '' END || CASE WHEN n % 60000 = 0 THEN '' WHEN n % 1000 = 0 THEN n % 60000 // 1000 || 'S' ELSE n % 60000 // 1000 || '.' || rtrim(lpad((n % 1000)::VARCHAR, 3, '0'), '0') || 'S' END END END AS iso
        FROM (SELECT *, CASE WHEN resolution = 'P1M' THEN owner_id % 30 ELSE owner_id * 1234567 END AS n FROM assoc WHERE time_series_type = 0)"""),
    "DML_5_duplicates": _q(lambda a: sets.duplicates(a, _changed(a)).select("assoc_id"), "SELECT assoc_id FROM assoc WHERE owner_id NOT IN (3, 8)"),
    "ASC_2_list": _links(
        lambda t: links.listed(t, first={"id_": 7}).select("id", "component_id", "attribute_id"),
        "SELECT id, component_id, attribute_id FROM links WHERE component_id = 7 ORDER BY id",
    ),
    "ASC_3_has": _links(
        lambda t: links.listed(t, first={"id_": 7}, second={"types": ["Part1"]}).limit(1).agg((F.count(F.lit(1)) > 0).alias("found")),
        "SELECT count(*) > 0 AS found FROM links WHERE component_id = 7 AND attribute_type = 'Part1'",
    ),
    "ASC_4_attribute_ids": _links(
        lambda t: links.ids(t, "attribute", first={"types": ["Supplier0"]}),
        "SELECT DISTINCT attribute_id FROM links WHERE component_type = 'Supplier0' ORDER BY 1",
    ),
    "ASC_4_component_ids": _links(
        lambda t: links.ids(t, "component", second={"types": ["Part2"]}),
        "SELECT DISTINCT component_id FROM links WHERE attribute_type = 'Part2' ORDER BY 1",
    ),
    "ASC_5_counts": _links(
        links.counts,
        "SELECT count(*) AS links, count(DISTINCT component_id) AS components, count(DISTINCT attribute_id) AS attributes FROM links",
    ),
    "ASC_6_counts_by_type": _links(
        lambda t: links.counts_by_type(t, "attribute"),
        "SELECT attribute_type, count(*) AS links FROM links GROUP BY 1 ORDER BY 1",
    ),
    "ASC_7_summary": _links(links.summary, "SELECT attribute_type, component_type, count(*) AS links FROM links GROUP BY ALL ORDER BY ALL"),
    "ASC_8_remove": _links(
        lambda t: links.removed(t, first={"types": ["Supplier1"]}).select("component_id", "attribute_id"),
        "SELECT component_id, attribute_id FROM links WHERE component_type <> 'Supplier1'",
    ),
    "ASC_9_reassign": _links(
        lambda t: links.reassigned(t, 7, 5_000_000).select("component_id", "component_type", "attribute_id"),
        "SELECT CASE component_id WHEN 7 THEN 5000000 ELSE component_id END AS component_id, component_type, attribute_id FROM links",
    ),
    "ASC_11_edges": _edges(
        lambda t: links.listed(t, links.EDGES, second={"types": ["Supplier"]}).select("parent_id", "child_id"),
        "SELECT parent_id, child_id FROM edges WHERE child_type = 'Supplier' ORDER BY id",
    ),
    "ASC_12_children": _edges(
        lambda t: links.ids(t, "child", ends=links.EDGES, first={"id_": 103}),
        "SELECT DISTINCT child_id FROM edges WHERE parent_id = 103 ORDER BY 1",
    ),
    "ASC_12_parents": _edges(
        lambda t: links.ids(t, "parent", ends=links.EDGES, second={"types": ["Customer"]}),
        "SELECT DISTINCT parent_id FROM edges WHERE child_type = 'Customer' ORDER BY 1",
    ),
    "ASC_13_remove_edges": _edges(
        lambda t: links.removed(t, links.EDGES, first={"types": ["Region"]}).select("parent_id", "child_id"),
        "SELECT parent_id, child_id FROM edges WHERE parent_type <> 'Region'",
    ),
    "ASC_14_reassign_edges": _edges(
        lambda t: links.edges_reassigned(t, 103, 9_000_000).select("parent_id", "child_id"),
        "SELECT CASE parent_id WHEN 103 THEN 9000000 ELSE parent_id END AS parent_id, CASE child_id WHEN 103 THEN 9000000 ELSE child_id END AS child_id FROM edges",
    ),
    "SNK_6_wire_rows": _q(lambda a: a.where("time_series_type = 3").orderBy(*catalog.typed_order()).select(
        F.to_json(
            F.struct(
                "owner_id",
                "owner_type",
                "owner_category",
                "name",
                wire_instant(F.col("initial_timestamp")).alias("initial_timestamp"),
                "resolution",
                "horizon",
                "interval",
                F.col("count"),
                "component_field",
                "data_hash",
            ),
        ).alias("json"),
    ),
        """SELECT '{"owner_id":' || owner_id || ',"owner_type":"' || owner_type || '","owner_category":"' || owner_category || '","name":"' || name || '","initial_timestamp":"' || strftime(initial_timestamp, '%Y-%m-%dT%H:%M:%SZ')
        || '","resolution":"' || resolution || '","horizon":"' || horizon || '","interval":"' || "interval" || '","count":' || "count" || coalesce(',"component_field":"' || component_field || '"', '') || ',"data_hash":"' || data_hash || '"}' AS json FROM assoc WHERE time_series_type = 3"""),
    "SNK_7_wire_links": _links(
        lambda t: t.orderBy("component_id", "attribute_id").select(
            F.to_json(F.struct("component_id", "component_type", "attribute_id", "attribute_type")).alias("json"),
        ),
        """SELECT '{"component_id":' || component_id || ',"component_type":"' || component_type || '","attribute_id":' || attribute_id || ',"attribute_type":"' || attribute_type || '"}' AS json FROM links""",
    ),
    "PER_14_wire_instants": (
        (lambda spark, d: fx.table(spark, d, "events").select("event_id", wire_instant(F.col("ts")).alias("at"))),
        "SELECT event_id, CASE WHEN epoch_us(ts) // 1000 % 1000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') || 'Z' END AS at FROM events",
    ),
    "PER_2_steps_between": ((
        lambda spark,
        d: fx.table(spark, d, "orders").select(
            "o_orderkey",
            Period.parse("P1M").steps(instant(dt.datetime(1995, 1, 31)), F.col("o_orderdate")).alias("k"),
            Period.parse("P1D").floor(instant(dt.datetime(1996, 1, 1, 5)), F.col("o_orderdate")).alias("days"),
            Period.parse("P1M").ceil(instant(dt.datetime(1995, 1, 31)), F.col("o_orderdate")).alias("months"),
        )
    ),
        """SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1995-01-31' AND TIMESTAMP '1995-01-31' + to_months(m::INT) = o_orderdate THEN m END::BIGINT AS k,
        greatest(0, floor((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1996-01-01 05:00:00')) / 86400000000))::BIGINT AS days,
        CASE WHEN o_orderdate <= TIMESTAMP '1995-01-31' THEN 0 WHEN TIMESTAMP '1995-01-31' + to_months(m::INT) < o_orderdate THEN m + 1 ELSE m END::BIGINT AS months
        FROM (SELECT *, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS m FROM orders)"""),
}
