import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridloom.errors import DuplicateTimeSeries, IntegrityError, InvalidParameter, NotFound, ReadOnlyStore, StoreExists
from gridloom.operators.filters import ListFilter
from gridloom.sources import csv_io
from gridloom.sources.store import Request, Store

T = dt.datetime(2024, 1, 1)


def load(owner=42, values=None, **more):
    return Request(owner, "Generator", "load", values or [float(i) for i in range(100, 124)], initial_timestamp=T, resolution="PT1H", **more)


def test_round_trip_on_disk(spark, tmp_path):
    path = f"{tmp_path}/s"
    store = Store.create(spark, path)
    with pytest.raises(StoreExists):
        Store.create(spark, path)
    events = Request(1, "Load", "events", [1.0, 2.0, 3.0], time_series_type=1, timestamps=[T, T + dt.timedelta(minutes=7), T + dt.timedelta(days=3)])
    store.add(load(features={"model_year": 2030}, units="MW"), load(43), events)
    store = Store.open(spark, path)
    assert store.associations.count() == 3 and store.tables["arrays"].count() == 2
    cut = store.get(ListFilter(owner_id=1), T, T + dt.timedelta(days=1)).first()
    assert cut["values"] == [1.0, 2.0]
    with pytest.raises(DuplicateTimeSeries):
        store.add(load(features={"model_year": 2030}))
    store.add(load(features={"model_year": 2031}))
    assert store.list(ListFilter(features={"model_year": 2031})).count() == 1
    assert store.verify().count() == 0
    with pytest.raises(ReadOnlyStore):
        Store.open(spark, path, read_only=True).clear()
    assert Store.open(spark, path).associations.count() == 4
    with pytest.raises(NotFound):
        Store.open(spark, f"{tmp_path}/none")
    kept = len(store.tables["arrays"].inputFiles())
    store.add(load(44, values=[9.0] * 24))
    # what was there stays as it is: an addition appends files
    assert len(store.tables["arrays"].inputFiles()) > kept and Store.open(spark, path).tables["arrays"].count() == 3
    assert Store.create(spark, path, replace=True).associations.count() == 0


@pytest.mark.parametrize("bad", [
    {"features": {"count": 1}}, {"features": {"x": float("nan")}}, {"shape": [3]}, {"resolution": "PT0S"}, {"initial_timestamp": dt.datetime(2024, 1, 1, 0, 0, 0, 1)}, {"time_series_type": 3}, {"time_series_type": 2},
])
def test_bad_requests_change_nothing(spark, bad):
    store = Store.create(spark)
    r = load()
    for k, v in bad.items():
        setattr(r, k, v)
    with pytest.raises(InvalidParameter):
        store.add(load(7), r)
    assert store.associations.count() == 0


def test_views_transactions_and_guards(spark):
    store = Store.create(spark)
    store.add(load(), load(43))
    assert store.transform("PT6H", "PT6H", dry_run=True) == 2
    assert store.transform("PT6H", "PT6H") == 2 and store.transform("PT6H", "PT6H") == 0
    w = store.windows(ListFilter(owner_id=42, time_series_type=2), T + dt.timedelta(hours=6), T + dt.timedelta(hours=12))
    assert [r.v for r in w.orderBy("h").collect()] == [106.0, 107.0, 108.0, 109.0, 110.0, 111.0]
    dense = Request(42, "Generator", "load", [0.0] * 24, time_series_type=2, shape=[6, 4], initial_timestamp=T, resolution="PT1H", horizon="PT6H", interval="PT3H", count=4)
    with pytest.raises(DuplicateTimeSeries):
        store.add(dense)
    with pytest.raises(IntegrityError):
        store.remove(ListFilter(time_series_type=0))
    with pytest.raises(DuplicateTimeSeries):
        store.replace_owner(42, 43)
    with pytest.raises(NotFound):
        store.remove(ListFilter(owner_id=1), at_least=1)
    assert store.remove(ListFilter(owner_id=43)) == 2
    store.copy(ListFilter(owner_id=42, time_series_type=0), 50, "Load")
    with pytest.raises(DuplicateTimeSeries):
        store.copy(ListFilter(owner_id=42, time_series_type=0), 50, "Load")
    assert store.sweep() == {"arrays": 0, "timestamp_sets": 0} and store.tables["arrays"].count() == 1


def test_merging_a_store_into_another(spark, tmp_path):
    source, dest = Store.create(spark), Store.create(spark, f"{tmp_path}/d")
    events = Request(1, "Load", "events", [1.0, 2.0], time_series_type=1, timestamps=[T, T + dt.timedelta(minutes=7)])
    source.add(load(), load(43, values=[5.0] * 24), events)
    source.transform("PT6H", "PT6H")
    dest.add(load(43, values=[7.0] * 24))
    with pytest.raises(DuplicateTimeSeries):
        dest.merge(source)
    assert dest.associations.count() == 1 and dest.merge(source, replace=True) == 5
    windows = dest.windows(ListFilter(owner_id=42, time_series_type=2), T + dt.timedelta(hours=6), T + dt.timedelta(hours=12))
    assert [r.v for r in windows.orderBy("h").collect()] == [106.0, 107.0, 108.0, 109.0, 110.0, 111.0]
    assert dest.get(ListFilter(owner_id=43, time_series_type=0)).first()["values"] == [5.0] * 24
    assert dest.verify().count() == 0 and dest.sweep()["arrays"] == 1
    assert dest.associations.where("time_series_type = 3").count() == 0 and dest.associations.select("assoc_id").distinct().count() == 5
    keys = spark.createDataFrame([(0, 42, 0), (1, 1, 1), (2, 43, 2)], "ordinal long, owner_id long, time_series_type int")
    got = {r["ordinal"]: r["values"] for r in dest.read_ranges(keys, ["owner_id", "time_series_type"], T, T + dt.timedelta(hours=2)).collect()}
    assert got == {0: [100.0, 101.0], 1: [1.0, 2.0], 2: [5.0] * 6}
    hashes = [r["data_hash"] for r in dest.associations.where("owner_id = 1").collect()]
    assert dest.array(hashes[0]).first()["element_type"] == "f64"
    with pytest.raises(NotFound):
        dest.array("0" * 64)


def test_large_integers_are_exact(spark):
    store = Store.create(spark)
    store.add(Request(1, "X", "big", [2**64 - 1, 0], element_type="u64", initial_timestamp=T, resolution="P1M"))
    assert int(store.read().first()["exact"][0]) == 2**64 - 1 and store.verify().count() == 0


def test_csv(spark, tmp_path):
    f = tmp_path / "wide.csv"
    f.write_text("timestamp,10,b\n" + "".join(f"2024-01-01T0{i}:00:00Z,{i},{i * 10}\n" for i in range(5)))
    with pytest.raises(InvalidParameter, match="b"):
        csv_io.read_wide(spark, str(f))
    rows = {r.owner_id: r["values"] for r in csv_io.read_wide(spark, str(f), {"10": 10, "b": (11, "Load")}).collect()}
    assert rows == {10: [0, 1, 2, 3, 4], 11: [0, 10, 20, 30, 40]}
    assert csv_io.layout(["timestamp", "value"]) == "timestamped" and csv_io.layout(["issue_time", "target_time", "p5"]) == "forecast"
    rows = csv_io.read_timestamped(spark, str(f))
    from gridloom.functions.period import Period

    csv_io.check_grid(rows, T, Period.parse("PT1H"), 5)
    with pytest.raises(InvalidParameter):
        csv_io.check_grid(rows, T, Period.parse("PT2H"), 5)
    g = tmp_path / "long.csv"
    g.write_text("value\n1.5\n2.5\n")
    assert csv_io.read_values(spark, str(g)).first()["values"] == [1.5, 2.5]
    g.write_text("1.5\n2.5\n")
    with pytest.raises(InvalidParameter):
        csv_io.read_values(spark, str(g))
    windows = spark.createDataFrame([(w, h, [float(w * 10 + h), 100.0 + w * 10 + h]) for w in range(3) for h in range(2)], "w long, h long, v array<double>")
    assert csv_io.forecast_values(windows, 2, 3, 2).first()["values"] == [0, 10, 20, 1, 11, 21, 100, 110, 120, 101, 111, 121]


def test_file_stems_are_distinct(spark):
    store = Store.create(spark)
    store.add(load(), load(features={"a": 1}), load(7))
    stems = [r.stem.lower() for r in csv_io.file_stems(store.associations).collect()]
    assert len(set(stems)) == 3
    assert '"units"' not in csv_io.wire_series(store.associations.where(F.col("owner_id") == 7)).first()["json"]


def test_wide_files_keep_every_column_and_quoted_cells(spark, tmp_path):
    n = 10_050
    path = tmp_path / "wide.csv"
    path.write_text("timestamp," + ",".join(f"c{i}" for i in range(n)) + "\n" + "\n".join(f'2024-01-01T0{h}:00:00,' + ",".join(f'"{h}"' if i == 3 else str(h * n + i) for i in range(n)) for h in range(3)) + "\n")
    rows = csv_io.read_timestamped(spark, str(path)).orderBy("row").collect()
    assert [(r["row"], r["t"], len(r["v"]), r["v"][3], r["v"][-1]) for r in rows] == [(h, T + dt.timedelta(hours=h), n, float(h), float(h * n + n - 1)) for h in range(3)]


def test_rows_of_a_file_in_blocks_keep_their_order(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("v\n" + "\n".join(str(i) for i in range(5000)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert csv_io.read_values(spark, str(path)).first()["values"] == [float(i) for i in range(5000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_series_from_csv_must_stand_on_its_grid(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("timestamp,value\n2024-01-01T00:00:00,1\n2024-01-01T01:00:00,2\n")
    about = {"owner_id": 1, "name": "load", "initial_timestamp": T, "resolution": "PT1H", "length": 2}
    row = csv_io.series_from_csv(spark, str(path), about).first()
    assert (row["owner_id"], row["length"], row["values"]) == (1, 2, [1.0, 2.0])
    for bad in ({"length": 3}, {"resolution": "PT2H"}, {"color": "red"}):
        with pytest.raises(InvalidParameter):
            csv_io.series_from_csv(spark, str(path), about | bad)


def test_all_or_nothing_is_removed_and_replaced(spark):
    store = Store.create(spark)
    store.add(load(1), load(2, values=[1.0] * 24), load(3))
    with pytest.raises(NotFound):
        store.remove_each([ListFilter(owner_id=1), ListFilter(owner_id=9)])
    assert store.associations.count() == 3
    assert store.remove_each([ListFilter(owner_id=1), ListFilter(owner_id=2)]) == 2 and store.sweep()["arrays"] == 1
    assert store.tables["arrays"].count() == 1
    with pytest.raises(DuplicateTimeSeries):
        store.add(load(3, values=[2.0] * 24))
    store.add(load(3, values=[2.0] * 24), load(4), replace=True)
    assert store.get(ListFilter(owner_id=3)).first()["values"] == [2.0] * 24 and store.associations.count() == 2
    assert {r["resolution_n"] for r in store.associations.collect()} == {3_600_000}
    with pytest.raises(InvalidParameter):
        store.add(load(5, values=[0.0] * 48, shape=[24, 2], element_type="tuple(3,f64)"))
    store.add(load(5, values=[0.0] * 72, shape=[24, 3], element_type="tuple(3,f64)"))


def test_readers_refuse_what_does_not_fit_together(spark):
    from gridloom.operators import readers

    store = Store.create(spark)
    store.add(load(1), load(2), load(3, values=[1.0] * 12))
    arrays = store.tables["arrays"]
    with pytest.raises(InvalidParameter):
        readers.static_reader(store.associations, arrays)
    assert readers.static_reader(store.associations, store.tables["arrays"], ListFilter(owner_id=1)).count() == 1
    with pytest.raises(InvalidParameter):
        readers.forecast_reader(store.associations, arrays, ListFilter(), ["owner_id"])
    dense = Request(4, "Generator", "load", [float(i) for i in range(12)], time_series_type=2, shape=[6, 2], initial_timestamp=T, resolution="PT1H", horizon="PT6H", interval="PT6H", count=2)
    store.add(dense)
    got = readers.forecast_reader(store.associations, store.tables["arrays"], ListFilter(owner_id=4), ["owner_id"], T + dt.timedelta(hours=6))
    assert [(r.h, r.v) for r in got.orderBy("h").collect()] == [(h, float(2 * h + 1)) for h in range(6)]
    with pytest.raises(InvalidParameter):
        readers.forecast_reader(store.associations, store.tables["arrays"], ListFilter(owner_id=4), ["owner_id"], T + dt.timedelta(hours=1))
