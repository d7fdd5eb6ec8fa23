import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from gridloom.errors import InvalidParameter
from gridloom.functions import elements, hashing, parse
from gridloom.functions.period import Period, instant, iso_of


def test_array_hash_is_the_published_value():
    assert hashing.array_hash("f64", [4], [0, 1, 2, 3]) == "f85b4f66e62c7c51f9c82d01eabed7fb5e3b5217a69296aaaff876e1144dd841"
    assert hashing.array_hash("f64", [2], [math.nan, 1]) == hashing.array_hash("f64", [2], [-math.nan, 1])
    assert hashing.array_hash("f64", [1], [0.0]) != hashing.array_hash("f64", [1], [-0.0])
    assert hashing.array_hash("u64", [1], [2**64 - 1]) != hashing.array_hash("i64", [1], [-1])


def test_feature_hash_is_strict_about_kinds():
    kinds = [{"a": 1}, {"a": 1.0}, {"a": True}, {"a": "1"}, {}]
    assert len({hashing.features_hash(k) for k in kinds}) == 5
    assert hashing.features_hash({"a": 1, "b": 2}) == hashing.features_hash({"b": 2, "a": 1})


def test_timestamps_use_the_coarsest_unit():
    t = dt.datetime(2024, 1, 1)
    hourly = [t + dt.timedelta(hours=i) for i in range(8760)]
    assert len(hashing.timestamps_blob(hourly)) < 8800
    assert hashing.timestamps_hash(hourly) != hashing.timestamps_hash(hourly[1:])


@pytest.mark.parametrize("text,canonical", [("PT60M", "PT1H"), ("P1W", "P7D"), ("P12M", "P1Y"), ("P14M", "P14M"), ("PT0.250S", "PT0.25S"), ("-P1DT2H", "-P1DT2H"), ("PT0S", "PT0S"), ("P1Y2M", "P14M")])
def test_periods_have_one_text(text, canonical):
    assert Period.parse(text).iso() == canonical
    assert Period.parse(canonical) == Period.parse(text)


@pytest.mark.parametrize("text", ["", "P", "PT", "1H", "P1MT1H", "PT1.2345S", "hourly", "P1Y1D"])
def test_bad_periods(text):
    with pytest.raises(InvalidParameter):
        Period.parse(text)


def test_month_ends_count_from_the_origin(spark):
    p, start = Period.parse("P1M"), dt.datetime(2024, 1, 31)
    want = [dt.datetime(2024, 1, 31), dt.datetime(2024, 2, 29), dt.datetime(2024, 3, 31), dt.datetime(2024, 4, 30)]
    assert [p.add_to(start, k) for k in range(4)] == want
    rows = spark.range(4).select(p.add(instant(start), F.col("id")).alias("t")).collect()
    assert [r.t for r in rows] == want
    assert p.steps_between(start, want[3]) == 3
    with pytest.raises(InvalidParameter):
        p.steps_between(start, dt.datetime(2024, 2, 28))
    assert (p.floor_steps(start, dt.datetime(2024, 2, 28)), p.ceil_steps(start, dt.datetime(2024, 2, 28))) == (0, 1)


def test_columns_and_values_agree(spark):
    at = [dt.datetime(2023, 12, 1), dt.datetime(2024, 1, 31), dt.datetime(2024, 2, 28, 23), dt.datetime(2024, 2, 29), dt.datetime(2025, 3, 1, 0, 0, 0, 1000)]
    df = spark.createDataFrame([(t,) for t in at], "t timestamp_ntz")
    start = dt.datetime(2024, 1, 31)
    for text in ("PT1H", "PT0.5S", "P1D", "P1M", "P3M", "P1Y"):
        p = Period.parse(text)
        rows = df.select("t", p.floor(instant(start), F.col("t")).alias("f"), p.ceil(instant(start), F.col("t")).alias("c")).collect()
        for r in rows:
            assert (r.f, r.c) == (p.floor_steps(start, r.t), p.ceil_steps(start, r.t)), (text, r.t)


def test_iso_columns(spark):
    values = [("fixed", 3_600_000), ("fixed", 90_061_250), ("fixed", -60_000), ("months", 24), ("months", 5), ("fixed", 0)]
    rows = spark.createDataFrame(values, "kind string, n long").select("kind", "n", iso_of(F.col("kind"), F.col("n")).alias("iso")).collect()
    assert [r.iso for r in rows] == [Period(r.kind, r.n).iso() for r in rows]


def test_literals():
    assert parse.timestamp("2024-01-01T02:00:00+02:00") == dt.datetime(2024, 1, 1)
    assert parse.timestamp("1704067200000") == dt.datetime(2024, 1, 1)
    with pytest.raises(InvalidParameter):
        parse.timestamp("2024-01-01T00:00:00")
    assert parse.timestamp("2024-01-01T00:00:00", "-05:00") == dt.datetime(2024, 1, 1, 5)
    assert [parse.feature(x) for x in ("7", "7.5", "true", "x7")] == [7, 7.5, True, "x7"]
    assert parse.series_type("single_time_series") == 0
    with pytest.raises(InvalidParameter):
        parse.hash_prefix("xyz")


def test_element_types():
    e = elements.ElementType.parse
    assert str(e("Tuple(3,f64)")) == "tuple(3,f64)" and str(e("PiecewiseLinear")) == "piecewise_linear"
    order = ["f64", "bool", "tuple(2,f64)", "linear_function", "quadratic_function", "piecewise_linear", "piecewise_step"]
    assert sorted(reversed(order), key=lambda t: e(t).sort_key()) == order
    for t, dims in (("tuple(3,f64)", [2]), ("piecewise_linear", [4]), ("piecewise_step", [3]), ("linear_function", [])):
        with pytest.raises(InvalidParameter):
            e(t).check_shape("f64", dims)
    e("piecewise_step").check_shape("f64", [1])


def test_ragged_values_survive_a_round_trip(spark):
    kind = elements.ElementType("piecewise_linear")
    df = spark.sql("select array(array(named_struct('x', 1D, 'y', 2D), named_struct('x', 3D, 'y', 4D)), array(named_struct('x', 5D, 'y', 6D)), cast(array() as array<struct<x:double,y:double>>)) as v")
    flat = df.select("v", elements.encoded(F.col("v"), kind).alias("f"))
    row = flat.select("f", elements.decoded(F.col("f"), kind, 5).alias("back"), "v", elements.valid(F.col("f"), kind, 5).alias("ok")).first()
    assert row.f == [2, 1, 2, 3, 4, 1, 5, 6, 0, 0, 0, 0, 0, 0, 0] and row.back == row.v and row.ok
    step = elements.ElementType("piecewise_step")
    df = spark.sql("select array(2D, 1D, 5D, 7D, 0D, 0D) as f")
    assert df.select(elements.decoded(F.col("f"), step, 6)[0].alias("x")).first().x.asDict() == {"x": [1, 5], "y": [7]}
    assert not df.select(elements.valid(F.array(*[F.lit(x) for x in (2.5, 0.0)]), step, 2).alias("ok")).first().ok


@pytest.mark.parametrize("seconds", [[], [0], [0, 60, 120], [-5, 0, 86_400, 86_400], [1, 2, 10**9]])
def test_timestamp_vectors_decode_to_what_was_encoded(seconds):
    from gridloom.errors import IntegrityError
    from gridloom.functions.hashing import timestamps_blob, timestamps_of

    times = [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s) for s in seconds]
    blob = timestamps_blob(times)
    assert timestamps_of(blob) == times
    for bad in (b"", b"\x02" + blob[1:], blob + b"\x00", *([blob[:-1]] if seconds else [])):
        with pytest.raises(IntegrityError):
            timestamps_of(bad)


def _values(spark, texts, column):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", column.alias("v")).collect()
    return [r["v"] for r in rows]


def _or_none(fn, text):
    from gridloom.errors import InvalidParameter

    try:
        return fn(text)
    except InvalidParameter:
        return None


def test_literals_of_columns_are_those_of_values(spark):
    from pyspark.sql import functions as F

    from gridloom.functions import parse, parse_columns
    from gridloom.functions.elements import ElementType

    t = F.col("t")
    stamps = ["2024-01-01T00:00:00Z", "2024-01-01T02:30:00.125+02:30", "2024-06-30 23:59:59-07:00", "1704067200000", "-5", " 2024-01-01T00:00:00Z ", "2024-01-01T05:00", "2024-13-01T00:00:00Z", "now", ""]
    for offset in (None, "-07:00", "Z"):
        assert _values(spark, stamps, parse_columns.timestamp(t, offset)) == [_or_none(lambda x: parse.timestamp(x, offset), x) for x in stamps]
    ranges = ["2024-01-01T00:00:00Z..2024-01-02T00:00:00Z", "0..1000", "2024-01-01T00:00:00Z"]
    got = [tuple(r) if r else None for r in _values(spark, ranges, parse_columns.time_range(t))]
    assert got == [_or_none(parse.time_range, x) for x in ranges]
    types = ["SingleTimeSeries", "single_time_series", "DETERMINISTIC", "Deterministic_Single_Time_Series", "scenarios", "other", ""]
    assert _values(spark, types, parse_columns.series_type(t)) == [_or_none(parse.series_type, x) for x in types]
    categories = ["component", "SUPPLEMENTAL_ATTRIBUTE", "Thing"]
    assert _values(spark, categories, parse_columns.owner_category(t)) == [_or_none(parse.owner_category, x) for x in categories]
    elements = ["f64", " F32 ", "bool", "tuple(3,f64)", "tuple(03, u64)", "Tuple(0,f64)", "tuple(2,x)", "PiecewiseLinear", "linear_function", "f65", ""]
    got = [tuple(r) if r else None for r in _values(spark, elements, parse_columns.element_type(t))]
    want = [_or_none(ElementType.parse, x) for x in elements]
    assert got == [(e.kind, e.dtype, e.arity) if e else None for e in want]
    features = ["1", "+7", "-3", "1.5", ".5", "2.", "1e3", "true", "false", "True", "abc", "", "9223372036854775807", "nan", "1_0"]
    for x, r in zip(features, _values(spark, features, parse_columns.feature(t)), strict=True):
        want = parse.feature(x)
        kind = {bool: "bool", int: "int", float: "float", str: "str"}[type(want)]
        assert (r["kind"], {"int": r["i"], "float": r["f"], "bool": r["b"], "str": r["s"]}[kind]) == (kind, want), x


def test_owner_maps(spark, tmp_path):
    from gridloom.errors import InvalidParameter
    from gridloom.sources import csv_io

    def read(*lines):
        (tmp_path / "m").write_text("\n".join(lines) + "\n")
        return [tuple(r) for r in csv_io.owner_map(spark, str(tmp_path / "m")).orderBy("owner_id").collect()]

    assert read("column,owner_id,owner_type", "a,1,Load", "b,2,") == [("a", 1, "Load"), ("b", 2, None)]
    assert read("column,owner_id", '"x,y",5') == [("x,y", 5, None)]
    for lines in (["name,id", "a,1"], ["column,owner_id", "a,1", "a,2"], ["column,owner_id", "a,b"], ["1,2", "a,1"]):
        try:
            read(*lines)
        except InvalidParameter:
            continue
        raise AssertionError(lines)
