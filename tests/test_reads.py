"""Range reads, merges, slots, feature sets, diagnostics, grids, chunks and files against plain Python."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gridloom.errors import DuplicateAssociation, DuplicateTimeSeries, InvalidParameter, NotFound
from gridloom.functions.hashing import array_hash
from gridloom.functions.period import Period, instant
from gridloom.functions.period_columns import Periods
from gridloom.operators import catalog, chunks, diagnostics, feature_sets, grids, merging, ranges, series, slots
from gridloom.operators.filters import ListFilter, feature_map
from gridloom.operators.merging import Catalog
from gridloom.schema import ARRAYS, ASSOCIATIONS, ATTRIBUTE_LINKS, TIMESTAMP_SETS
from gridloom.sources import csv_io, link_json, series_files, typed_csv

T0 = dt.datetime(2024, 1, 1)
HOUR, DAY = Period.parse("PT1H"), Period.parse("P1D")


def rows(spark, schema, items):
    """A table of a schema from dictionaries; what they do not name is null."""
    from pyspark.sql.types import _parse_datatype_string

    names = [f.name for f in _parse_datatype_string(schema)]
    return spark.createDataFrame([tuple(i.get(n) for n in names) for i in items], schema)


def association(i, kind, data_hash, **more):
    base = {
        "assoc_id": i, "owner_id": i, "owner_type": "Generator", "owner_category": "Component", "time_series_type": kind,
        "name": "load", "element_type": "f64", "element_shape": [], "features": {}, "features_hash": "none", "data_hash": data_hash,
    }
    return base | more


def single(i, data_hash, n, **more):
    return association(i, 0, data_hash, **({"initial_timestamp": T0, "resolution": "PT1H", "length": n} | more))


def view(i, data_hash, n, horizon="PT4H", interval="PT2H", count=3, **more):
    return association(i, 3, data_hash, **({"initial_timestamp": T0, "resolution": "PT1H", "length": n, "horizon": horizon, "interval": interval, "count": count} | more))


def array(data_hash, values, shape=None):
    return {"data_hash": data_hash, "dtype": "f64", "shape": shape or [len(values)], "values": [float(v) for v in values]}


def catalog_of(spark, associations, arrays):
    return Catalog(rows(spark, ASSOCIATIONS, associations), rows(spark, ARRAYS, arrays))


TEXTS = ["PT1H", "P1D", "P2W", "PT15M", "PT1.5S", "-PT30M", "P1M", "P1Y", "P1Y6M", "PT0S", "PT36H", "P1DT2H3M4.005S"]
WRONG = ["", "P", "PT", "1H", "P1H", "PT1D", "P1M2D", "PT1.2345S", "hour"]


def test_periods_of_columns_are_those_of_values(spark):
    got = spark.createDataFrame([(t,) for t in TEXTS + WRONG], "t string").select("t", Periods.of(F.col("t")).kind, Periods.of(F.col("t")).n).collect()
    for text, kind, n in got:
        assert (kind, n) == ((Period.parse(text).kind, Period.parse(text).n) if text in TEXTS else (None, None)), text


def test_period_arithmetic_of_columns(spark):
    starts = [T0, dt.datetime(2023, 1, 31), dt.datetime(2024, 2, 29, 5, 30)]
    ats = [T0, dt.datetime(2023, 2, 28), dt.datetime(2024, 3, 31), dt.datetime(2024, 1, 1, 7, 45), dt.datetime(2020, 1, 1), dt.datetime(2026, 5, 31, 5, 30)]
    texts = ["PT1H", "P1D", "PT15M", "P1M", "P3M", "P1Y"]
    cases = [(t, s, a) for t in texts for s in starts for a in ats]
    p = Periods.of(F.col("t"))
    table = spark.createDataFrame(cases, "t string, s timestamp_ntz, a timestamp_ntz")
    got = table.select("*", p.floor(F.col("s"), F.col("a")).alias("f"), p.ceil(F.col("s"), F.col("a")).alias("c"), p.steps(F.col("s"), F.col("a")).alias("k"), p.add(F.col("s"), F.lit(5)).alias("x")).collect()
    for t, s, a, f, c, k, x in got:
        period = Period.parse(t)
        exact = period.floor_steps(s, a) if a >= s and period.add_to(s, period.floor_steps(s, a)) == a else None
        assert (f, c, k, x) == (period.floor_steps(s, a), period.ceil_steps(s, a), exact, period.add_to(s, 5)), (t, s, a)
    pairs = [(a, b) for a in [*TEXTS, "P3M"] for b in [*TEXTS, "P3M"]]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", Periods.of(F.col("a")).divide_into(Periods.of(F.col("b"))).alias("n")).collect()
    for a, b, n in got:
        try:
            want = Period.parse(a).divide_into(Period.parse(b))
        except InvalidParameter:
            want = None
        assert n == want, (a, b)


def mixed(spark):
    """A single series of pairs, a monthly one, an irregular one, a dense forecast, scenarios and a view."""
    stamps = [T0 + dt.timedelta(hours=h) for h in (0, 1, 5, 9)]
    associations = [
        single(1, "pairs", 6, element_shape=[2]),
        single(2, "months", 5, resolution="P1M", initial_timestamp=dt.datetime(2023, 10, 31)),
        association(3, 1, "irregular", length=4, timestamps_hash="axis"),
        association(4, 2, "dense", initial_timestamp=T0, resolution="PT1H", length=2, horizon="PT2H", interval="PT3H", count=4, element_shape=[4]),
        association(5, 5, "scenarios", initial_timestamp=T0, resolution="PT1H", length=2, horizon="PT2H", interval="PT3H", count=4, element_shape=[2, 4]),
        view(6, "pairs", 6, horizon="PT2H", interval="PT3H", count=2, element_shape=[2]),
        association(7, 2, "once", initial_timestamp=T0, resolution="PT1H", length=3, horizon="PT3H", interval="PT0S", count=1, element_shape=[1]),
    ]
    arrays = [
        array("pairs", range(12), [6, 2]), array("months", range(5)), array("irregular", range(4)), array("dense", range(8), [2, 4]),
        array("scenarios", range(16), [2, 2, 4]), array("once", range(3), [3, 1]),
    ]
    vectors = rows(spark, TIMESTAMP_SETS, [{"timestamps_hash": "axis", "timestamps": stamps}])
    return rows(spark, ASSOCIATIONS, associations), rows(spark, ARRAYS, arrays), vectors


def read(spark, ids, start, end):
    keys = spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "ordinal long, assoc_id long")
    out = ranges.read_ranges(keys, ["assoc_id"], *mixed(spark), instant(start), instant(end))
    return {r["ordinal"]: r for r in out.collect()}


def test_one_range_read_of_every_kind(spark):
    got = read(spark, [1, 2, 3, 4, 5, 6, 1], T0 + dt.timedelta(hours=3), T0 + dt.timedelta(hours=7))
    hour = lambda h: T0 + dt.timedelta(hours=h)
    assert (got[0]["values"], got[0]["initial_timestamp"], got[0]["length"], got[0]["shape"]) == (list(range(6, 12)), hour(3), 3, [3])
    # a step that begins before the range and reaches into it belongs to it
    assert (got[1]["values"], got[1]["initial_timestamp"], got[1]["length"]) == ([2.0], dt.datetime(2023, 12, 31), 1)
    assert (got[2]["values"], got[2]["timestamps"]) == ([2.0], [hour(5)])
    assert (got[3]["values"], got[3]["shape"], got[3]["count"], got[3]["initial_timestamp"]) == ([1, 2, 5, 6], [2, 2], 2, hour(3))
    assert (got[4]["values"], got[4]["shape"]) == ([1, 2, 5, 6, 9, 10, 13, 14], [2, 2, 2])
    # window 1 of the view has the steps 3 and 4, each a pair
    assert (got[5]["values"], got[5]["shape"], got[5]["count"]) == ([6, 7, 8, 9], [2, 1], 1)
    assert got[6]["values"] == got[0]["values"] and len(got) == 7


def test_ranges_that_are_refused(spark):
    at = lambda h: T0 + dt.timedelta(hours=h)
    for ids, start, end, kind in (
        ([1], at(3), at(2), InvalidParameter), ([4], at(1), at(5), InvalidParameter), ([4], at(12), at(15), InvalidParameter),
        ([7], at(1), at(2), InvalidParameter), ([1, 99], at(0), at(1), NotFound),
    ):
        with pytest.raises(kind):
            read(spark, ids, start, end)
    assert read(spark, [7], T0, at(1))[0]["values"] == [0, 1, 2] and read(spark, [7], T0, T0)[0]["values"] == []
    empty = read(spark, [1, 3], at(100), at(200))
    assert [empty[k]["length"] for k in (0, 1)] == [0, 0]


def test_views_land_as_dense_forecasts_made_once(spark):
    values = [float(v * v) for v in range(8)]
    source = catalog_of(spark, [single(1, "a", 8), view(1, "a", 8), view(2, "a", 8), view(3, "a", 8, count=2)], [array("a", values)])
    got = merging.merged(catalog_of(spark, [], []), source)
    held = {r["data_hash"]: r for r in got.arrays.collect()}
    out = {(r["owner_id"], r["time_series_type"]): r for r in got.associations.collect()}
    want = [values[c * 2 + h] for h in range(4) for c in range(3)]
    assert set(out) == {(1, 0), (1, 2), (2, 2), (3, 2)} and len(held) == 3
    dense = held[out[1, 2]["data_hash"]]
    assert (dense["values"], dense["shape"]) == (want, [4, 3]) and dense["data_hash"] == array_hash("f64", [4, 3], want)
    assert out[1, 2]["data_hash"] == out[2, 2]["data_hash"] and (out[1, 2]["length"], out[1, 2]["element_shape"]) == (4, [3])
    read_ = lambda a, f: sorted(map(tuple, f(a).select("w", "h", "v", "target_time").collect()))
    both = got.associations.where("owner_id = 1 and time_series_type = 2").join(got.arrays, "data_hash")
    views = source.associations.where("owner_id = 1 and time_series_type = 3").join(source.arrays, "data_hash")
    two = Period.parse("PT2H")
    assert read_(both, lambda a: series.dense_windows(a, [], 4, HOUR, two)) == read_(views, lambda a: series.derived_windows(a, [], Period.parse("PT4H"), two, HOUR))


def test_merges_that_clash(spark):
    one = catalog_of(spark, [single(1, "a", 3), view(2, "a", 3, horizon="PT2H", interval="PT1H", count=2)], [array("a", [1, 2, 3])])
    dense = catalog_of(spark, [association(2, 2, "d", initial_timestamp=T0, resolution="PT1H", length=2, horizon="PT2H", interval="PT1H", count=2)], [array("d", [9] * 4, [2, 2])])
    other = catalog_of(spark, [single(1, "b", 3), single(5, "a", 3)], [array("b", [4, 5, 6]), array("a", [1, 2, 3])])
    with pytest.raises(DuplicateTimeSeries):
        merging.merged(one, other)
    with pytest.raises(DuplicateTimeSeries):  # the view lands as the forecast that is there
        merging.merged(dense, one)
    with pytest.raises(DuplicateTimeSeries):  # a family holds views or dense forecasts
        merging.merged(one, dense)
    got = merging.merged(one, other, replace=True)
    assert {(r["owner_id"], r["time_series_type"]): r["data_hash"] for r in got.associations.collect()} == {(1, 0): "b", (2, 3): "a", (5, 0): "a"}
    assert sorted(r["data_hash"] for r in got.arrays.collect()) == ["a", "b"]
    again = merging.merged(dense, one, replace=True)
    assert {(r["owner_id"], r["time_series_type"]) for r in again.associations.collect()} == {(1, 0), (2, 2)}
    lost = Catalog(one.associations, one.arrays.where("false"))
    with pytest.raises(NotFound):
        merging.merged(dense, lost, replace=True)
    odd = catalog_of(spark, [view(2, "a", 3, horizon="PT90M")], [array("a", [1, 2, 3])])
    with pytest.raises(InvalidParameter):
        merging.merged(dense, odd, replace=True)


def test_slots_are_read_once(spark):
    associations, arrays, vectors = mixed(spark)
    again = associations.withColumns({"assoc_id": F.col("assoc_id") + 100, "owner_id": F.col("owner_id") + 100})
    twice = associations.unionByName(again)
    found = slots.slots_of(slots.slotted(twice))
    at = instant(T0 + dt.timedelta(hours=3))
    assert found.count() == 7 and slots.read_slots(found, arrays, vectors, at).count() == 4
    got = {r["assoc_id"]: r["values"] for r in slots.read_at(twice, arrays, vectors, at, ["assoc_id"]).collect()}
    want = {1: [6, 7], 4: [1, 5], 5: [1, 5, 9, 13], 6: [6, 7, 8, 9]}
    assert got == want | {k + 100: v for k, v in want.items()}
    irregular = slots.read_at(associations, arrays, vectors, instant(T0 + dt.timedelta(hours=9)), ["assoc_id"]).collect()
    assert {r["assoc_id"]: r["values"] for r in irregular} == {3: [3.0], 4: [3.0, 7.0], 5: [3.0, 7.0, 11.0, 15.0]}


def test_conditions_on_feature_sets_stay_below_the_join(spark):
    items = [({"year": 2024, "zone": "a"}, "h1"), ({"year": 2024}, "h2"), ({}, "h3"), ({"year": 2024.0}, "h4")]
    table = None
    for i, (features, key) in enumerate(items * 2):
        row = spark.range(1).select(F.lit(i).alias("assoc_id"), F.lit(key).alias("features_hash"), feature_map(features).alias("features"))
        table = row if table is None else table.union(row)
    plain, sets = feature_sets.split(table)
    assert sets.count() == 4 and "features" not in plain.columns
    ids = lambda df: sorted(r["assoc_id"] for r in df.select("assoc_id").collect())
    assert ids(feature_sets.with_features(plain, sets, {"year": 2024})) == [0, 1, 4, 5]
    assert ids(feature_sets.with_exactly(plain, sets, {"year": 2024})) == [1, 5] and ids(feature_sets.with_exactly(plain, sets, {})) == [2, 6]
    assert ids(feature_sets.with_features(plain, sets, {})) == list(range(8))
    assert ids(feature_sets.hydrated(plain, sets).where("size(features) = 1")) == [1, 3, 5, 7]
    assert ids(feature_sets.missing(plain, sets.where("features_hash <> 'h1'"))) == [0, 4]
    plan = feature_sets.with_features(plain, sets, {"year": 2024})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") < plan.index("2024")


def test_one_row_of_a_key(spark):
    table = rows(spark, ASSOCIATIONS, [single(1, "a", 3), single(2, "b", 3), single(2, "c", 3)])
    table = table.withColumn("features", F.when(F.col("owner_id") == 1, feature_map({"year": 1})).otherwise(F.col("features")))
    from gridloom.errors import IntegrityError

    key = ListFilter(owner_id=1, time_series_type=0, exact_type=True, name="load", features={"year": 1})
    assert [r["data_hash"] for r in catalog.by_key(table, key).collect()] == ["a"]
    with pytest.raises(NotFound):  # the features of a key are all features
        catalog.by_key(table, ListFilter(owner_id=1, name="load"))
    with pytest.raises(IntegrityError):
        catalog.by_key(table, ListFilter(owner_id=2, name="load"))


def test_every_broken_rule_is_reported(spark):
    good = array_hash("f64", [3], [1.0, 2.0, 3.0])
    arrays = [array(good, [1, 2, 3]), array("0" * 64, [1, 2])]
    items = [
        single(1, good, 3),
        single(2, "short", -1, element_type="tuple(0,f64)"),
        single(3, "0" * 64, 2),
        single(4, "f" * 64, 3, resolution=None),
        association(5, 1, good, timestamps_hash="gone", length=3),
        association(6, 9, good, owner_category=None, name=None),
        view(7, "0" * 64, 2, count=None, horizon="PT-1H"),
        association(8, 4, good, initial_timestamp=T0, resolution="PT1H", horizon="PT2H", interval="PT1H", count=2),
    ]
    got = diagnostics.verified(rows(spark, ASSOCIATIONS, items), rows(spark, ARRAYS, arrays), rows(spark, TIMESTAMP_SETS, [])).collect()
    want = {
        (2, "data_hash is no hash"), (2, "element_type is invalid"), (2, "length is negative"), (3, "array has another hash"),
        (4, "array is missing"), (4, "resolution or initial_timestamp is missing"), (5, "timestamps are not stored"),
        (6, "type is unknown"), (6, "owner_category is unknown"), (6, "owner or name is missing"), (6, "horizon, interval or count is missing"),
        (6, "resolution or initial_timestamp is missing"), (7, "horizon, interval or count is missing"), (7, "horizon is no positive period"),
        (7, "array has another hash"), (8, "percentiles are missing"),
    }
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_labels_of_grids(spark):
    items = [(1, "load", [], [1.0, 2.0]), (2, "load", [], [3.0, 4.0]), (3, "load", [2], [5.0, 6.0, 7.0, 8.0])]
    make = lambda its: spark.createDataFrame([(o, n, 0, s, T0, v) for o, n, s, v in its], "owner_id long, name string, time_series_type int, element_shape array<int>, initial_timestamp timestamp_ntz, values array<double>").orderBy("owner_id", "name")
    wide = grids.grid(make(items), HOUR)
    assert wide.columns == ["t", "1", "2", "3[0]", "3[1]"]
    assert [tuple(r) for r in wide.orderBy("t").collect()] == [(T0, 1, 3, 5, 6), (T0 + dt.timedelta(hours=1), 2, 4, 7, 8)]
    two = make([*items, (1, "wind", [], [9.0, 9.0])])
    assert grids.grid(two, HOUR).columns == ["t", "load@1", "wind@1", "load@2", "load@3[0]", "load@3[1]"]
    assert grids.grid(make(items), HOUR, "full").columns[1] == "load@1"
    with pytest.raises(InvalidParameter):
        grids.grid(two, HOUR, "owner")
    with pytest.raises(NotFound):
        grids.grid(two.where("false"), HOUR)
    late = two.withColumn("initial_timestamp", F.when(F.col("owner_id") == 1, instant(dt.datetime(2025, 1, 1))).otherwise(F.col("initial_timestamp")))
    with pytest.raises(InvalidParameter):
        grids.grid(late, HOUR)


def test_a_read_at_one_step_takes_one_chunk(spark, tmp_path):
    items = [array("a", range(100)), array("b", range(60), [30, 2]), array("c", range(24)), array("none", [], [0])]
    chunks.write(rows(spark, ARRAYS, items), str(tmp_path / "c"))
    table = chunks.read(spark, str(tmp_path / "c"))
    get = lambda df: {r["data_hash"]: r["values"] for r in df.collect()}
    assert get(chunks.at_step(table, 25)) == {"a": [25.0], "b": [50.0, 51.0]}
    assert get(chunks.at_step(table, 23)) == {"a": [23.0], "b": [46.0, 47.0], "c": [23.0]}
    assert get(chunks.between(table, 20, 50)) == {"a": list(map(float, range(20, 50))), "b": list(map(float, range(40, 60))), "c": [20.0, 21.0, 22.0, 23.0]}
    chosen = chunks.at_step(table, 25)
    assert {f.split("chunk=")[1].split("/")[0] for f in table.inputFiles()} == {"0", "1", "2", "3", "4"}
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chunk" in plan and "(chunk" in plan.split("PartitionFilters")[1][:80]


def test_links_from_json_are_taken_whole_or_not_at_all(spark):
    stored = rows(spark, ATTRIBUTE_LINKS, [{"id": 4, "component_id": 1, "component_type": "A", "attribute_id": 2, "attribute_type": "B"}])
    link = lambda c, a, **more: json.dumps({"component_id": c, "component_type": 'A "x"', "attribute_id": a, "attribute_type": "B"} | more)
    make = lambda *texts: spark.createDataFrame([(t,) for t in texts], "json string")
    got = link_json.imported(make(link(1, 3), link(-2, 2)), stored)
    assert sorted((r["component_id"], r["attribute_id"], r["component_type"]) for r in got.collect()) == [(-2, 2, 'A "x"'), (1, 2, "A"), (1, 3, 'A "x"')]
    assert got.select("id").distinct().count() == 3 and got.agg(F.min("id")).first()[0] == 4
    for text in (link(5, 5, extra=1), link("5", 5), link(5, 1.5), link(5, None), '{"component_id":1}', "[]", "", "null", link(5, 5)[:-1], link(5, 5, attribute_type=7)):
        with pytest.raises(InvalidParameter):
            link_json.imported(make(link(1, 3), text), stored)
    for text in (link(1, 2), link(1, 3)):
        with pytest.raises(DuplicateAssociation):
            link_json.imported(make(link(1, 3), text), stored)
    whole = spark.createDataFrame([(f"[{link(1, 3)},{link(7, 7)}]",)], "json string")
    assert link_json.imported(link_json.objects(whole), stored).count() == 3
    assert link_json.imported(make(), stored).count() == 1


def test_an_object_is_read_once_a_row(spark):
    """However often the rules name the parts of an object, what makes its text stands once in the plan, and its keys are listed once."""
    made = spark.range(1).select(F.to_json(F.struct("id")).alias("json"))
    plan = link_json.parsed(made)._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("StructsToJson"), plan.count("jsonObjectKeys"), plan.count("json_tuple")) == (1, 1, 1), plan
    assert link_json.parsed(made).first()["problem"] == "unknown field id"


FORECAST = {"initial_timestamp": "2024-01-01T00:00:00Z", "resolution": "PT1H", "horizon": "PT2H", "interval": "P1D", "count": 2, "name": "x"}


def forecast_csv(columns, cells):
    lines = [f"issue_time,target_time,{columns}"]
    for d in range(2):
        for h in range(2):
            issue = T0 + dt.timedelta(days=d)
            lines.append(f"{issue.isoformat()}Z,{(issue + dt.timedelta(hours=h)).isoformat()}Z,{cells(d, h)}")
    return lines


def test_typed_series_of_files(spark, tmp_path):
    def make(file, lines, **description):
        (tmp_path / file).write_text("\n".join(lines) + "\n")
        return typed_csv.typed_series(spark, str(tmp_path / file), description).first()

    values = ["value", *map(str, range(8))]
    kinds = {"time_series_type": "Deterministic"} | FORECAST
    assert (make("v", values[:5], **kinds)["shape"], make("v2", values, **kinds | {"element_shape": [2], "element_type": "tuple(2,f64)"})["shape"]) == ([2, 2], [2, 2, 2])
    row = make("d", forecast_csv("v", lambda d, h: f"{10 * d + h}"), **kinds)
    assert (row["values"], row["shape"], row["count"], row["horizon"]) == ([0, 10, 1, 11], [2, 2], 2, "PT2H")
    three = forecast_csv("a,b,c", lambda d, h: ",".join(str(100 * s + 10 * d + h) for s in range(3)))
    row = make("s", three, **kinds | {"time_series_type": "Scenarios"})
    assert (row["shape"], row["values"][:4], row["values"][8:]) == ([3, 2, 2], [0, 10, 1, 11], [200, 210, 201, 211])
    row = make("p", three, **kinds | {"time_series_type": "Probabilistic", "percentiles": [10.0, 50.0, 90.0]})
    assert (row["shape"], row["percentiles"]) == ([3, 2, 2], [10, 50, 90])
    assert make("sv", ["value", *map(str, range(12))], **kinds | {"time_series_type": "Scenarios"})["shape"] == [3, 2, 2]
    row = make("i", ["timestamp,a", "2024-01-01T00:00:00Z,1", "2024-01-01T00:07:00Z,2"], time_series_type="NonSequentialTimeSeries", name="x")
    assert (row["timestamps"], row["values"], row["initial_timestamp"]) == ([T0, T0 + dt.timedelta(minutes=7)], [1, 2], None)
    regular = {"initial_timestamp": "2024-01-01T00:00:00Z", "resolution": "PT1H", "name": "x"}
    assert make("r", values, **regular)["shape"] == [8] and make("r2", values, **regular, element_shape=[4], element_type="tuple(4,f64)")["shape"] == [2, 4]
    for file, lines, description in (
        ("b1", values[:4], kinds),
        ("b2", values, kinds | {"time_series_type": "Scenarios", "count": 3}),
        ("b3", three, kinds),
        ("b4", three[:-1], kinds | {"time_series_type": "Scenarios"}),
        ("b5", [*three[:-1], three[-2]], kinds | {"time_series_type": "Scenarios"}),
        ("b6", three, kinds | {"time_series_type": "Probabilistic", "percentiles": [50.0, 10.0, 90.0]}),
        ("b7", three, kinds | {"time_series_type": "Scenarios", "scenario_count": 2}),
        ("b8", three, regular),
        ("b9", values, regular | {"length": 7}),
        ("b10", values, regular | {"element_shape": [3], "element_type": "tuple(3,f64)"}),
        ("b11", values, {"time_series_type": "NonSequentialTimeSeries", "name": "x"}),
        ("b12", values, kinds | {"time_series_type": "DeterministicSingleTimeSeries"}),
        ("b13", values, regular | {"colour": 1}),
        ("b14", ["timestamp,a", "2024-01-01T00:07:00Z,1", "2024-01-01T00:00:00Z,2"], {"time_series_type": "NonSequentialTimeSeries", "name": "x"}),
        ("b15", ["timestamp,a", "2024-01-01T00:00:00Z,1", "2024-01-01T02:00:00Z,2"], regular),
        ("b16", values, {k: v for k, v in regular.items() if k != "resolution"}),
        ("b17", forecast_csv("v", lambda d, h: "1")[:-1] + ["2024-01-05T00:00:00Z,2024-01-05T00:00:00Z,1"], kinds),
    ):
        with pytest.raises(InvalidParameter):
            make(file, lines, **description)


def test_one_file_a_series(spark, tmp_path):
    items = [(i, i % 3, "Generator", "Load" if i == 4 else "load" if i == 1 else f"n/{i}", 0, "PT1H", None, T0, [float(i), float(i + 1)]) for i in range(6)]
    table = spark.createDataFrame(items, "assoc_id long, owner_id long, owner_type string, name string, time_series_type int, resolution string, interval string, initial_timestamp timestamp_ntz, values array<double>")
    names = {r["assoc_id"]: r["stem"] for r in series_files.write(table, HOUR, str(tmp_path / "f")).collect()}
    got: dict = {}
    for r in series_files.read(spark, str(tmp_path / "f")).orderBy("t").collect():
        got.setdefault((r["stem"], r["file"]), []).append((r["t"], r["v"]))
    assert len({s.lower() for s in names.values()}) == 6 and {s for s, _ in got} == set(names.values()) and len(got) == 6
    assert all(got[k] == [(T0, float(i)), (T0 + dt.timedelta(hours=1), i + 1.0)] for i, s in names.items() for k in got if k[0] == s)


def test_wide_files_give_back_their_columns(spark, tmp_path):
    (tmp_path / "w").write_text('timestamp,7,"a,b"\n2024-01-01T00:00:00Z,1,2\n2024-01-01T01:00:00Z,3,4\n')
    got = csv_io.read_wide(spark, str(tmp_path / "w"), {"7": 7, "a,b": (8, "Load")}).orderBy("owner_id").collect()
    assert [tuple(r) for r in got] == [(7, None, "7", [1.0, 3.0]), (8, "Load", "a,b", [2.0, 4.0])]


def test_forecasts_beside_what_came_true(spark):
    from gridloom.operators import charts

    table = spark.createDataFrame([("s", T0, list(range(0, 120, 10)), 3)], "name string, initial_timestamp timestamp_ntz, values array<long>, count long")
    period = lambda t: Period.parse(t)
    got = charts.overlaid(table, ["name"], HOUR, period("PT4H"), period("PT2H"), 5).orderBy("w", "h").collect()
    want = [(w, h, T0 + dt.timedelta(hours=2 * w + h + 5), 10 * (2 * w + h), 10 * (2 * w + h + 5)) for w in range(3) for h in range(4) if 2 * w + h + 5 < 12]
    assert [(r["w"], r["h"], r["target_time"], r["v"], r["actual"]) for r in got] == want
    error = charts.forecast_error(table, ["name"], HOUR, period("PT4H"), period("PT2H"), 5).first()["error"]
    assert error == sum(v - a for *_, v, a in want)
