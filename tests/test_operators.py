import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridloom.errors import DuplicateAssociation, InvalidParameter
from gridloom.functions.period import Period
from gridloom.operators import catalog, charts, links, series
from gridloom.operators.filters import endpoint, glob_regex
from gridloom.schema import ATTRIBUTE_LINKS, COMPONENT_EDGES

NAMES = ["pump 1", "pump 12", "pump*", "[draft]", "draft", "d", "50%", "straße", "", "z?z", "zaz"]


@pytest.mark.parametrize(
    "pattern,want",
    [
        ("pump ?", {"pump 1"}),
        ("pump*", {"pump 1", "pump 12", "pump*"}),
        ("pump[*]", {"pump*"}),
        ("[[]*", {"[draft]"}),
        ("[draft]", {"d"}),
        ("[^a-p]*", {"[draft]", "50%", "straße", "z?z", "zaz"}),
        ("stra?e", {"straße"}),
        ("z?z", {"z?z", "zaz"}),
        ("z[?]z", {"z?z"}),
        ("PUMP*", set()),
        ("", {""}),
        ("*", set(NAMES)),
        ("zaz[", set()),
    ],
)
def test_glob(spark, pattern, want):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    assert {r.name for r in df.where(F.col("name").rlike(glob_regex(pattern))).collect()} == want


def one(spark, values, start=dt.datetime(2024, 1, 1)):
    return spark.createDataFrame([(start, len(values), values)], "initial_timestamp timestamp_ntz, length long, values array<double>")


@pytest.mark.parametrize("a,b,want,first", [("01:30", "03:00", [1, 2], 1), ("02:00", "02:00", [], 2), ("00:00", "23:59", [0, 1, 2, 3], 0), ("05:00", "06:00", [], 4), ("01:00", "01:01", [1], 1)])
def test_slices_take_the_steps_that_cover_the_range(spark, a, b, want, first):
    at = lambda x: dt.datetime(2024, 1, 1, *map(int, x.split(":")))
    row = series.slice_regular(one(spark, [0.0, 1.0, 2.0, 3.0]), Period.parse("PT1H"), at(a), at(b)).first()
    assert row["values"] == want and row["length"] == len(want) and row["initial_timestamp"] == dt.datetime(2024, 1, 1, first)


def test_a_slice_cannot_end_before_it_starts(spark):
    with pytest.raises(InvalidParameter):
        series.slice_regular(one(spark, [1.0]), Period.parse("PT1H"), dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 1))


def test_windows_must_start_on_the_grid():
    t, day = dt.datetime(2024, 1, 1), Period.parse("P1D")
    d = lambda n, h=0: dt.datetime(2024, 1, n, h)
    assert series.resolve_windows(t, day, 5) == (0, 5)
    assert series.resolve_windows(t, day, 5, d(2), d(4)) == (1, 3)
    assert series.resolve_windows(t, day, 5, d(2), d(4, 1)) == (1, 4)
    assert series.resolve_windows(t, day, 5, d(2), d(2)) == (1, 1)
    assert series.resolve_windows(t, Period("fixed", 0), 1, t, d(2)) == (0, 1)
    for bad in ((d(1, 1), d(3)), (d(6), d(9)), (d(3), d(2))):
        with pytest.raises(InvalidParameter):
            series.resolve_windows(t, day, 5, *bad)


def test_derived_windows_equal_dense_ones(spark):
    values = [float(i) for i in range(10)]
    view = series.derived_windows(one(spark, values).withColumn("count", F.lit(4).cast("long")), [], Period.parse("PT4H"), Period.parse("PT2H"), Period.parse("PT1H"))
    flat = [float(2 * w + h) for h in range(4) for w in range(4)]
    dense = series.dense_windows(one(spark, flat).withColumn("count", F.lit(4).cast("long")), [], 4, Period.parse("PT1H"), Period.parse("PT2H"))
    cols = ["w", "h", "issue_time", "target_time", "v"]
    assert sorted(map(tuple, view.select(*cols).collect())) == sorted(map(tuple, dense.select(*cols).collect()))


def test_transform_plans():
    p, t = Period.parse, dt.datetime(2024, 1, 1)
    assert series.transform_plan([("PT1H", t, 720)], p("P2D"), p("P1D")) == {"PT1H": (p("P1D"), 29)}
    assert series.transform_plan([("PT1H", t, 48)], p("P2D"), p("P2D"), normalize=True) == {"PT1H": (Period("fixed", 0), 1)}
    assert series.transform_plan([("PT1H", t, 48)], p("P2D"), p("P2D")) == {"PT1H": (p("P2D"), 1)}
    for horizon, interval in (("PT90M", "PT1H"), ("P31D", "P1D"), ("PT2H", "PT3H"), ("P2D", "PT0S")):
        with pytest.raises(InvalidParameter):
            series.transform_plan([("PT1H", t, 720)], p(horizon), p(interval))


def test_links(spark):
    t = spark.createDataFrame([(1, 7, "A", 1, "x"), (2, 7, "A", 2, "y"), (3, 8, "B", 3, "x")], ATTRIBUTE_LINKS)
    with pytest.raises(DuplicateAssociation):
        links.added(t, spark.createDataFrame([(4, 7, "Z", 1, "z")], ATTRIBUTE_LINKS))
    moved = links.reassigned(t, 7, 8)
    assert {(r.component_id, r.component_type) for r in moved.collect()} == {(8, "B")}
    with pytest.raises(DuplicateAssociation):
        links.reassigned(t.union(spark.createDataFrame([(4, 8, "B", 1, "x")], ATTRIBUTE_LINKS)), 7, 8)
    assert t.where(endpoint("component", types=[])).count() == 0
    e = spark.createDataFrame([(1, 1, "R", 1, "R"), (2, 1, "R", 2, "N")], COMPONENT_EDGES)
    assert sorted((r.parent_id, r.child_id) for r in links.edges_reassigned(e, 1, 9).collect()) == [(9, 2), (9, 9)]


def test_sparkline_takes_the_extreme_of_each_bucket(spark):
    rows = spark.createDataFrame([(0, [1.0, 5.0, 1.0, float("nan"), 1.0, -9.0]), (1, [float("nan")] * 2), (2, [])], "k long, values array<double>")
    assert {(r.k, r.bucket): r.v for r in charts.sparkline(rows, ["k"], 3).collect()} == {(0, 0): 5.0, (0, 1): 1.0, (0, 2): -9.0}


def test_charts_and_statistics_of_arrays(spark):
    nan, inf = float("nan"), float("inf")
    t = dt.datetime(2024, 1, 1, 22)
    rows = spark.createDataFrame([(0, t, [3.0, nan, 1.0, inf]), (1, t, [7.0]), (2, t, [])], "k long, initial_timestamp timestamp_ntz, values array<double>")
    assert [tuple(r) for r in charts.duration_curve(rows, ["k"]).orderBy("k", "rank").collect()] == [(0, 1, 0.0, 3.0), (0, 2, 50.0, 1.0), (1, 1, 0.0, 7.0)]
    assert sorted(map(tuple, charts.heatmap(rows, ["k"], Period.parse("PT1H")).collect())) == [(0, 0, 1, 1.0), (0, 22, 0, 3.0), (1, 22, 0, 7.0)]
    got = {r.k: r for r in catalog.statistics(rows, ["k"]).collect()}
    assert (got[0].num_elements, got[0].non_finite, got[0].first, got[0].last, got[0].p50, got[0].p95) == (4, 2, 3.0, inf, 2.0, pytest.approx(2.9))
    assert got[1].stddev == 0.0 and got[0].stddev == pytest.approx(2**0.5) and got[2].mean is None and got[2].p5 is None and got[2].num_elements == 0
