"""Steps whose cost must not grow faster than the input: what their plans carry, and the whole job where a limit was."""

import datetime as dt
import gzip
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions.hashing import array_hash
from gridloom.functions.period import Period
from gridloom.errors import InvalidParameter, NotFound
from gridloom.functions.tables import ARRAY_ROWS, shared_folder, written
from gridloom.operators import grids, merging, ranges, series
from gridloom.plans import file_queries, fixtures, read_queries
from gridloom.sources import series_files, store

from test_reads import array, catalog_of, single, view

SMOKE = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)
HOUR = Period.parse("PT1H")


def optimised(df) -> list[str]:
    return df._jdf.queryExecution().optimizedPlan().toString().split("\n")


def sorted_arrays(df) -> list[str]:
    """What sorts rows that hold arrays, in the plan without broadcasts."""

    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    conf, name = df.sparkSession.conf, "spark.sql.autoBroadcastJoinThreshold"
    before = conf.get(name)
    conf.set(name, "-1")
    try:
        plan = df.select("*")._jdf.queryExecution().sparkPlan()
    finally:
        conf.set(name, before)
    sorts = [n for n in nodes(plan) if n.nodeName() in ("Sort", "SortMergeJoin", "SortAggregate")]
    inputs = [(n.nodeName(), n.children().apply(i).output().mkString(",")) for n in sorts for i in range(n.children().size())]
    return [name for name, columns in inputs if "values#" in columns]


def test_resolutions_are_parsed_before_steps_are_exploded(spark):
    plan = optimised(read_queries._static_range(spark, SMOKE))
    first = next(i for i, line in enumerate(plan) if "Generate" in line)
    assert not any("regexp_extract" in line for line in plan[:first]), plan[: first + 1]


def test_cells_are_filled_without_a_lookup_a_place(spark):
    items = [[(5, 7), (0, 3), (2, None), (9, 1), (-1, 8), (10, 8)], [], [(9, 4)], [(0, 1)], [(12, 1)]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "k long, cells array<struct<idx:long,v:long>>")
    out = rows.select("k", fixtures._filled(F.col("cells"), 10).alias("v"))
    want = [[3, 0, 0, 0, 0, 7, 0, 0, 0, 1], [0] * 10, [0] * 9 + [4], [1] + [0] * 9, [0] * 10]
    assert [r["v"] for r in out.orderBy("k").collect()] == want
    assert not any("try_element_at" in line.lower() or "map_from_entries" in line for line in optimised(out))


def test_no_window_carries_the_whole_array(spark):
    rows = spark.createDataFrame([(1, T0, list(range(10)), 3)], "k long, initial_timestamp timestamp_ntz, values array<long>, count long")
    out = series.derived_windows(rows, ["k"], Period.parse("PT4H"), Period.parse("PT2H"), HOUR, windows=(1, 9))
    got = [(r["w"], r["h"], r["v"], r["issue_time"], r["target_time"]) for r in out.orderBy("w", "h").collect()]
    hour = lambda n: T0 + dt.timedelta(hours=n)
    assert got == [(w, h, 2 * w + h, hour(2 * w), hour(2 * w + h)) for w in (1, 2) for h in range(4)]
    explode = [line for line in optimised(out) if "Generate" in line]
    assert len(explode) == 2 and "slice" in explode[1], explode


def test_a_grid_may_have_more_columns_than_a_plan(spark):
    n = grids.MOST_COLUMNS + 300
    kinds = F.lit(0).alias("time_series_type"), F.expr("cast(array() as array<int>)").alias("element_shape")
    values = F.array(F.col("id").cast("double"), -F.col("id").cast("double"))
    rows = spark.range(n).select(F.col("id").alias("owner_id"), F.lit("load").alias("name"), F.lit(T0).cast("timestamp_ntz").alias("initial_timestamp"), *kinds, values.alias("values"))
    got = grids.blocks(rows, ["owner_id"], HOUR).orderBy("block", "t").collect()
    for k, sign in ((0, 1), (1, -1)):
        at = [r for r in got if r["t"] == T0 + dt.timedelta(hours=k)]
        assert [c for r in at for c in r["columns"]] == [str(i) for i in range(n)]
        assert [v for r in at for v in r["cells"]] == [sign * i for i in range(n)]
    pair = rows.where("owner_id < 3").withColumns({"element_shape": F.array(F.lit(2)), "name": F.concat(F.lit("n"), F.col("owner_id") % 2)})
    assert [(r["columns"], r["cells"]) for r in grids.blocks(pair, ["owner_id"], HOUR).collect()] == [(["n0@0[0]", "n0@0[1]", "n1@1[0]", "n1@1[1]", "n0@2[0]", "n0@2[1]"], [0, 0, 1, -1, 2, -2])]
    late = rows.where("owner_id < 3").withColumn("initial_timestamp", F.col("initial_timestamp") + F.make_dt_interval(F.col("owner_id")))
    for wrong, label, error in ((rows.where("false"), "auto", NotFound), (late, "auto", InvalidParameter), (rows.unionByName(rows), "owner", InvalidParameter)):
        with pytest.raises(error):
            grids.blocks(wrong, ["owner_id"], HOUR, label)


def test_files_of_series_are_made_without_their_steps(spark, tmp_path):
    """One row a series goes to the files, odd values come back, and a path that exists is refused."""
    odd = [1.5, None, float("inf"), -1e300, 0.1]
    kinds = "assoc_id long, owner_id long, owner_type string, name string, time_series_type int, resolution string, interval string, initial_timestamp timestamp_ntz, values array<double>"
    table = spark.createDataFrame([(i, i, "Generator", "é" if i else "x y", 0, "PT1H", None, T0, odd if i < 2 else []) for i in range(3)], kinds)
    at = str(tmp_path / "f g")
    names = {r["assoc_id"]: r["stem"] for r in series_files.write(table, HOUR, at).collect()}
    held = sorted((tmp_path / "f g").rglob("part-*"))
    assert len(held) == 2 and {p.parent.name for p in held} == {f"stem={names[0]}", f"stem={names[1]}"}
    assert held[0].read_text().split("\n")[:3] == ["timestamp,value", "2024-01-01T00:00:00Z,1.5", "2024-01-01T01:00:00Z,"]
    got = sorted((r["stem"], r["t"], r["v"]) for r in series_files.read(spark, at).where("stem like '%x_y'").collect())
    assert got == [(names[0], T0 + dt.timedelta(hours=i), v) for i, v in enumerate(odd)]
    with pytest.raises(InvalidParameter):
        series_files.write(table, HOUR, at)
    assert not [p for p in (tmp_path / "f g").rglob("*") if p.name.startswith(".")]


def test_packed_files_are_whole_and_small(spark, tmp_path):
    """The query's files lie packed in the numbered folders; unpacked they are those that write() makes without packing."""
    root = Path(shared_folder(spark).removeprefix("file:"))
    before = set(root.glob("series-*"))
    rows = file_queries.QUERIES["SNK_4_file_by_series"][0](spark, SMOKE).collect()
    (made,) = set(root.glob("series-*")) - before
    held = [p for p in made.rglob("*") if p.is_file() and p.suffix != ".crc"]
    texts = [gzip.decompress(p.read_bytes()) for p in held]
    assert len(held) == len(rows) > 0 and {p.parent.parent for p in held} == {made}
    assert all(t.count(b"\n") == 721 for t in texts) and 4 * sum(p.stat().st_size for p in held) < sum(map(len, texts))

    kinds = "assoc_id long, owner_id long, owner_type string, name string, time_series_type int, resolution string, interval string, initial_timestamp timestamp_ntz, values array<double>"
    odd = [1.5, None, float("inf"), -1e300, 0.1]
    table = spark.createDataFrame([(i, i % 2, "Generator", "é" if i else ".csv.gz", 0, "PT1H", None, T0, odd if i < 4 else []) for i in range(5)], kinds)
    plain, packed = tmp_path / "plain", tmp_path / "packed"
    for at, so in ((plain, False), (packed, True)):
        series_files.write(table, HOUR, str(at), packed=so)
    want = {p.parent.name.removeprefix("stem="): p.read_bytes() for p in plain.rglob("part-*")}
    assert len(want) == 4 and {p.name.removesuffix(".csv.gz"): gzip.decompress(p.read_bytes()) for p in packed.rglob("*.gz")} == want
    (packed / "7").mkdir(exist_ok=True)
    (packed / "7" / ".0a").write_bytes(b"half")
    got, same = ([tuple(r)[:3] for r in series_files.read(spark, str(at)).orderBy("stem", "t").collect()] for at in (packed, plain))
    assert got == same and len(got) == 20
    assert spark.read.option("header", True).option("recursiveFileLookup", True).csv(f"{packed}/*/*.gz").count() == 20


def test_few_arrays_go_to_python_at_once(spark):
    """What hashes arrays takes them in small batches, and the session keeps its own setting."""

    @F.pandas_udf("long")
    def size(x: pd.Series) -> pd.Series:
        return pd.Series([len(x)] * len(x))

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = spark.range(0, 2000, 1, 1).withColumn("n", size("id"))
    assert written(rows, "few", ARRAY_ROWS).agg(F.max("n")).first()[0] == ARRAY_ROWS
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_windows_of_one_value_a_step_are_not_sliced(spark):
    """The dense array of a view, whole, by a later first window, with pairs, and where the array ends too early."""
    cases = [(10, 4, 0, 3, 2, 1), (10, 4, 1, 3, 2, 1), (8, 2, 0, 2, 1, 2), (10, 4, 0, 4, 3, 1), (4, 4, 0, 1, 0, 1), (4, 2, 0, 0, 1, 1)]
    rows = spark.createDataFrame([(list(map(float, range(n))), s, f, c, t, w) for n, s, f, c, t, w in cases], "v array<double>, s long, f long, c long, t long, w long")
    out = rows.select("*", ranges.windows_of_single(*map(F.col, "vsfctw")).alias("got"))
    for r in out.collect():
        want = [((r["f"] + c) * r["t"] + h) * r["w"] + e for h in range(r["s"]) for c in range(r["c"]) for e in range(r["w"])]
        assert r["got"] == [float(p) for p in want if p < len(r["v"])], r
    assert any("CASE WHEN" in line for line in optimised(out)), optimised(out)


def test_merging_sorts_no_arrays(spark):
    """Arrays pass by the hashes that they are joined with; a dense array that the source holds already comes once."""
    values = [float(v) for v in range(8)]
    cut = [values[c * 2 + h] for h in range(4) for c in range(3)]
    same = array_hash("f64", [4, 3], cut)
    rows = [single(1, "a", 8), view(2, "a", 8), view(3, "a", 8), single(4, same, 12)]
    source = catalog_of(spark, rows, [array("a", values), array(same, cut, [4, 3]), array("unused", [1.0])])
    into = catalog_of(spark, [single(1, "old", 2), single(5, "kept", 2)], [array("old", [1.0, 2.0]), array("kept", [3.0, 4.0])])
    got = merging.merged(into, source, replace=True)
    assert sorted(r["data_hash"] for r in got.arrays.collect()) == sorted(["a", "kept", same])
    assert {(r["owner_id"], r["time_series_type"]): r["data_hash"] for r in got.associations.collect()} == {
        (1, 0): "a", (2, 2): same, (3, 2): same, (4, 0): same, (5, 0): "kept",
    }
    assert sorted_arrays(got.arrays) == []


def test_totals_are_taken_before_the_join(spark):
    plan = optimised(read_queries._merged_replaced(spark, SMOKE))
    join = next(i for i, line in enumerate(plan) if "Join Inner" in line)
    assert not any("aggregate(" in line for line in plan[:join]), plan[: join + 1]


def test_adding_sorts_no_arrays(spark, monkeypatch):
    """Of a batch each array is stored once, found by its hash and row number; exact integers and features are hashed as before."""
    kept = {}

    def recorded(df, name, batch=None):
        kept.setdefault(name, []).append(df)
        return written(df, name, batch)

    monkeypatch.setattr(store, "written", recorded)
    held = store.Store.create(spark)
    of = lambda owner, values, **more: store.Request(owner, "Generator", "load", values, initial_timestamp=T0, resolution="PT1H", **more)
    big = [2**64 - 1, 0, 5]
    held.add(of(1, [1.0, float("nan")]), of(2, [1.0, float("nan")]), of(3, [3.0]), of(4, big, element_type="u64"), of(5, [], features={"year": 2024}))
    held.add(of(3, [1.0, float("nan")]), of(6, [6.0]), replace=True)
    want = [array_hash("f64", [len(v)], v) for v in ([1.0, float("nan")], [3.0], [], [6.0])] + [array_hash("u64", [3], big)]
    assert sorted(r["data_hash"] for r in held.tables["arrays"].collect()) == sorted(want)
    assert {r["owner_id"]: r["data_hash"] for r in held.associations.collect()} == {1: want[0], 2: want[0], 3: want[0], 4: want[4], 5: want[2], 6: want[3]}
    assert [sorted_arrays(df) for df in kept["arrays"]] == [[], []]


def test_steps_are_stamped_by_an_interval(spark):
    rows = spark.createDataFrame([(1, T0, [1.0, 2.0, 3.0])], "k long, initial_timestamp timestamp_ntz, values array<double>")
    for text, gap in (("PT1H", dt.timedelta(hours=1)), ("PT0.001S", dt.timedelta(milliseconds=1)), ("P400D", dt.timedelta(days=400)), ("PT0S", dt.timedelta(0))):
        out = series.steps(rows, Period.parse(text), ["k"])
        assert [(r["idx"], r["t"], r["v"]) for r in out.orderBy("idx").collect()] == [(i, T0 + i * gap, i + 1.0) for i in range(3)]
        assert not any("timestampadd(" in line.lower() for line in optimised(out))
