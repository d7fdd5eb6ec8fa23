"""Reads of series: slices, windows, sweeps, statistics, charts, arrays and files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.elements import ElementType, decoded, encoded
from ..functions.period import Period, micros
from ..operators import catalog, charts, grids, readers, series
from ..operators.filters import ListFilter  # noqa: F401
from . import fixtures as fx

HOUR, DAY, TWO_DAYS, MONTH = map(Period.parse, ("PT1H", "P1D", "P2D", "P1M"))
_START, _END = dt.datetime(2024, 1, 5, 6, 30), dt.datetime(2024, 1, 7, 0, 15)
_M_START, _M_END = dt.datetime(1996, 2, 29), dt.datetime(1997, 3, 2)
_PERCENTILES = (5.0, 50.0, 95.0)
_OWNER = ["owner_id", "name"]


def _hourly(fn):
    return lambda spark, d: fn(fx.hourly(spark, d))


def _h(fn, sql: str):
    return _hourly(fn), f"WITH {fx.SQL_HOURLY} {sql}"


def _m(fn, sql: str):
    return (lambda spark, d: fn(fx.monthly(spark, d))), f"WITH {fx.SQL_MONTHLY} {sql}"


def _views(rows):
    return rows.withColumn("count", F.lit(29).cast("long"))


def _dense(rows):
    """[24, 30] forecasts: window c has the hours of day c."""
    of = lambda v: F.transform(F.sequence(F.lit(0), F.lit(719)), lambda i: F.get(v, (i % 30) * 24 + F.floor(i / 30).cast("int")))
    swapped = F.element_at(F.transform(F.array("values"), of), 1)
    return rows.withColumns({"values": swapped, "count": F.lit(30)})


def _cells(rows, value, group, size):
    """[size, 24, 30] arrays by name from (name, g, idx, v), ordered by their flat place."""
    place = (F.col("g") * 24 + F.col("idx") % 24) * 30 + F.floor(F.col("idx") / 24)
    out = rows.select("name", place.cast("long").alias("place"), F.col(value).alias("v"))
    out = out.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda x: x["v"]).alias("values"))
    return out.withColumns({"initial_timestamp": fx.ntz(fx.T0), "count": F.lit(30)})


def _scenarios(rows):
    long = series.steps(rows, HOUR, _OWNER).groupBy("name", (F.col("owner_id") % 5).alias("g"), "idx").agg(F.sum("v").alias("v"))
    return series.dense_windows(_cells(long, "v", "g", 5), ["name"], 24, HOUR, DAY)


def _probabilistic(rows):
    long = series.steps(rows, HOUR, _OWNER).groupBy("name", "idx").agg(
        F.percentile(F.col("v"), F.array(*[F.lit(p / 100) for p in _PERCENTILES])).alias("p"),
    )
    long = long.select("name", "idx", F.posexplode("p").alias("g", "v"))
    return series.dense_windows(_cells(long, "v", "g", 3), ["name"], 24, HOUR, DAY)


_QUANTILES = "FROM (SELECT name, idx, unnest([0, 1, 2]) AS p, unnest(quantile_cont(v::DOUBLE, [0.05::DOUBLE, 0.5::DOUBLE, 0.95::DOUBLE])) AS v FROM hourly GROUP BY name, idx)"


def _statistics(rows):
    """Every 97th value and the first of some series is not a number, or infinite."""
    odd = lambda x, i: F.when(
        (F.col("owner_id") + i) % 97 == 0,
        F.when(i % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("-inf"))),
    ).otherwise(x.cast("double"))
    out = catalog.statistics(rows.withColumn("values", F.transform("values", odd)), _OWNER)
    return out.select(
        *_OWNER,
        "num_elements",
        "non_finite",
        "min",
        "max",
        *[F.round(c, 4).alias(c) for c in ("mean", "stddev", "p5", "p25", "p50", "p75", "p95")],
    )


def _ends(rows):
    return catalog.statistics(rows, _OWNER).select(*_OWNER, "first", "last", "num_elements", "non_finite")


def _booleans(rows):
    return catalog.boolean_statistics(rows.withColumn("values", F.transform("values", lambda x: x > 0)), _OWNER)


def _pairs(spark, d):
    """Embeddings as tuple(64, f32), one row of the tuple a component."""
    e = fx.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("values"))
    return e.select(
        "vec_id",
        F.posexplode(decoded(F.col("values"), ElementType.parse("tuple(64,f32)"), 64)[0]).alias("i", "v"),
    ).select("vec_id", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


def _functions(spark, d):
    """A piecewise linear value for each order (its line count as points), encoded and decoded again."""
    li = fx.table(spark, d, "lineitem")
    points = li.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("double").alias("x"), F.col("l_quantity").alias("y")))).alias("p"),
    )
    flat = points.select("l_orderkey", encoded(F.array("p"), ElementType("piecewise_linear")).alias("values"), (F.size("p") * 2 + 1).alias("w"))
    one = F.transform(
        F.sequence(F.lit(1), F.get("values", F.lit(0)).cast("int")),
        lambda i: F.struct(F.element_at("values", 2 * i).alias("x"), F.element_at("values", 2 * i + 1).alias("y")),
    )
    return flat.select("l_orderkey", F.explode(one).alias("q")).select("l_orderkey", F.col("q.x").alias("x"), F.col("q.y").alias("y"))


def _grid(rows):
    return grids.side_by_side(rows, ["owner_id"], "name", fx.EVENTS, HOUR)


def _irregular_slice(spark, d):
    cut = series.slice_irregular(fx.irregular(spark, d), _START, _END)
    return cut.select("owner_id", F.explode(F.arrays_zip("timestamps", "values")).alias("x")).select(
        "owner_id",
        F.col("x.timestamps").alias("t"),
        F.col("x.values").alias("v"),
    )


def _overlay(rows):
    """Forecasts made a day before: what a view of the day before says, beside what came true."""
    return charts.overlaid(_views(rows), _OWNER, HOUR, TWO_DAYS, DAY, 24)


def _one_window(rows):
    k = readers.window_index(fx.T0, DAY, 29, dt.datetime(2024, 1, 21))
    return series.derived_windows(_views(rows), _OWNER, TWO_DAYS, DAY, HOUR, windows=(k, k + 1)).select(*_OWNER, "h", "v")


def _wide(spark, d):
    """A wide table (owner and timestamp by name) back to one series a column."""
    grid = _grid(fx.hourly(spark, d))
    long = grid.unpivot(["owner_id", "t"], [c for c in grid.columns if c not in ("owner_id", "t")], "column", "v")
    return long.where(F.col("v").isNotNull()).select("owner_id", "column", "t", "v")


_VIEW = "owner_id, name, w, h, v, issue_time, target_time"
_VIEWS = """FROM (SELECT owner_id, name, k.w::BIGINT AS w, idx - k.w * 24 AS h, v, TIMESTAMP '2024-01-01' + to_days(k.w::INT) AS issue_time, t AS target_time
    FROM hourly JOIN range(29) k(w) ON idx BETWEEN k.w * 24 AND k.w * 24 + 47)"""
#: The windows beside what came true a day after.
_OVERLAY = """FROM (SELECT h.owner_id, h.name, k.w::BIGINT AS w, h.idx - k.w * 24 AS h, a.t AS target_time, h.v, a.v AS actual
    FROM hourly h JOIN range(29) k(w) ON h.idx BETWEEN k.w * 24 AND k.w * 24 + 47
    JOIN hourly a ON a.owner_id = h.owner_id AND a.name = h.name AND a.idx = h.idx + 24)"""

QUERIES = {
    "SLC_1_slice_regular": _h(
        lambda r: series.steps(series.slice_regular(r, HOUR, _START, _END), HOUR, _OWNER),
        "SELECT owner_id, name, idx - 102 AS idx, t, v FROM hourly WHERE idx >= 102 AND idx < 145",
    ),
    "SLC_1_slice_monthly": _m(
        lambda r: series.steps(series.slice_regular(r, MONTH, _M_START, _M_END), MONTH, ["name"]),
        "SELECT name, idx - 13 AS idx, t, v FROM monthly WHERE idx >= 13 AND idx < 27",
    ),
    "SLC_2_slice_irregular": (
        _irregular_slice,
        f"WITH {fx.SQL_IRREGULAR} SELECT owner_id, t, v FROM activity WHERE t >= TIMESTAMP '2024-01-05 06:30:00' AND t < TIMESTAMP '2024-01-07 00:15:00'",
    ),
    "SLC_3_get_series": _h(
        lambda r: series.steps(r.where("owner_id = 5 and name = 'click'"), HOUR, _OWNER),
        "SELECT owner_id, name, idx, t, v FROM hourly WHERE owner_id = 5 AND name = 'click'",
    ),
    "SLC_5_bulk_read": _h(
        lambda r: series.steps(
            r.join(
                F.broadcast(
                    r.sparkSession.createDataFrame([(0, 3, "view"), (1, 5, "click"), (2, 3, "view")], "ordinal long, owner_id long, name string"),
                ),
                _OWNER,
            ),
            HOUR,
            ["ordinal", *_OWNER],
        ),
        "SELECT k.ordinal::BIGINT AS ordinal, owner_id, name, idx, t, v FROM hourly JOIN (VALUES (0, 3, 'view'), (1, 5, 'click'), (2, 3, 'view')) k(ordinal, o, n) ON owner_id = o AND name = n",
    ),
    "SLC_7_month_grid": _m(
        lambda r: r.select(
            "name",
            F.explode(
                F.transform(F.sequence(F.lit(0).cast("long"), F.lit(79).cast("long")), lambda i: MONTH.add(fx.ntz(dt.datetime(1995, 1, 31)), i)),
            ).alias("t"),
        ),
        "SELECT name, TIMESTAMP '1995-01-31' + to_months(idx::INT) AS t FROM monthly",
    ),
    "SLC_8_index_of": _h(
        lambda r: r.select(
            *_OWNER,
            HOUR.steps(F.col("initial_timestamp"), HOUR.add(fx.ntz(dt.datetime(2024, 1, 9, 4)), F.col("owner_id") % 50)).alias("i"),
        ),
        "SELECT DISTINCT owner_id, name, 196 + owner_id % 50 AS i FROM hourly",
    ),
    "SLC_9_row_window": _h(
        lambda r: series.row_window(series.steps(r.where("owner_id = 5 and name = 'click'"), HOUR, []), F.col("idx"), stride=7, tail=20),
        "SELECT idx, t, v FROM hourly WHERE owner_id = 5 AND name = 'click' AND idx % 7 = 0 ORDER BY idx DESC LIMIT 20",
    ),
    "SRC_9_read_at_index": _h(
        lambda r: readers.static_read(r, fx.T0, HOUR, dt.datetime(2024, 1, 12, 3), _OWNER),
        "SELECT owner_id, name, v FROM hourly WHERE idx = 267",
    ),
    "FCW_3_deterministic": _h(
        lambda r: series.dense_windows(_dense(r), _OWNER, 24, HOUR, DAY).select(*_OWNER, "w", "h", "issue_time", "target_time", "v"),
        "SELECT owner_id, name, idx // 24 AS w, idx % 24 AS h, TIMESTAMP '2024-01-01' + to_days((idx // 24)::INT) AS issue_time, t AS target_time, v FROM hourly",
    ),
    "FCW_2_window_range": _h(
        lambda r: series.dense_windows(
            _dense(r),
            _OWNER,
            24,
            HOUR,
            DAY,
            windows=series.resolve_windows(fx.T0, DAY, 30, dt.datetime(2024, 1, 4), dt.datetime(2024, 1, 9, 1)),
        ).select(*_OWNER, "w", "h", "v"),
        "SELECT owner_id, name, idx // 24 AS w, idx % 24 AS h, v FROM hourly WHERE idx // 24 BETWEEN 3 AND 8",
    ),
    "FCW_4_probabilistic": _h(
        lambda r: _probabilistic(r).select("name", "p", "w", "h", F.round("v", 4).alias("v")),
        f"SELECT name, p::BIGINT AS p, idx // 24 AS w, idx % 24 AS h, round(v, 4) AS v {_QUANTILES}",
    ),
    "FCW_5_scenarios": _h(
        lambda r: _scenarios(r).select("name", "p", "w", "h", "v"),
        "SELECT name, owner_id % 5 AS p, idx // 24 AS w, idx % 24 AS h, sum(v)::BIGINT AS v FROM hourly GROUP BY ALL",
    ),
    "FCW_6_derived_windows": _h(
        lambda r: series.derived_windows(_views(r), _OWNER, TWO_DAYS, DAY, HOUR).select(
            "owner_id",
            "name",
            "w",
            "h",
            "v",
            "issue_time",
            "target_time",
        ),
        f"SELECT {_VIEW} {_VIEWS}",
    ),
    "FCW_7_one_window": _h(
        lambda r: series.derived_windows(_views(r), _OWNER, TWO_DAYS, DAY, HOUR, windows=(9, 10)).select(
            "owner_id",
            "name",
            "w",
            "h",
            "v",
            "issue_time",
            "target_time",
        ),
        f"SELECT {_VIEW} {_VIEWS} WHERE w = 9",
    ),
    "FCW_12_window_trace": _h(
        lambda r: series.derived_windows(
            _views(r.where("owner_id = 4 and name = 'view'")),
            _OWNER,
            TWO_DAYS,
            DAY,
            HOUR,
            windows=(2, 3),
        ).orderBy("h").select("target_time", "v"),
        f"SELECT target_time, v {_VIEWS} WHERE owner_id = 4 AND name = 'view' AND w = 2 ORDER BY h",
    ),
    "RDR_3_static_sweep": _h(lambda r: readers.static_sweep(r, HOUR, _OWNER), "SELECT t, owner_id, name, v FROM hourly"),
    "RDR_5_forecast_read": _h(_one_window, f"SELECT owner_id, name, h, v {_VIEWS} WHERE issue_time = TIMESTAMP '2024-01-21'"),
    "RDR_7_timeline": _h(
        lambda r: series.steps(r.where("owner_id = 5 and name = 'click'"), HOUR, []).select("idx", "t"),
        "SELECT DISTINCT idx, t FROM hourly",
    ),
    "RDR_8_grid": _h(
        _grid,
        "SELECT owner_id, t, " + ", ".join(
            f"sum(v) FILTER (WHERE name = '{n}')::BIGINT AS {n}" for n in fx.EVENTS
        ) + " FROM hourly GROUP BY owner_id, t",
    ),
    "SRC_20_wide_table": (_wide, f"WITH {fx.SQL_HOURLY} SELECT owner_id, name AS \"column\", t, v FROM hourly"),
    "AGG_11_statistics": _h(_statistics, """SELECT owner_id, name, count(*) AS num_elements, count(*) FILTER (WHERE o) AS non_finite,
        min(v) FILTER (WHERE NOT o)::DOUBLE AS min, max(v) FILTER (WHERE NOT o)::DOUBLE AS max, round(avg(v) FILTER (WHERE NOT o), 4) AS mean, round(stddev_samp(v::DOUBLE) FILTER (WHERE NOT o), 4) AS stddev,
        """ + ", ".join(f"round(quantile_cont(v::DOUBLE, {p / 100}::DOUBLE) FILTER (WHERE NOT o), 4) AS p{p}" for p in (5, 25, 50, 75, 95)) + " FROM (SELECT *, (owner_id + idx) % 97 = 0 AS o FROM hourly) GROUP BY owner_id, name"),
    "AGG_11_ends": _h(
        _ends,
        "SELECT owner_id, name, arg_min(v, idx)::DOUBLE AS first, arg_max(v, idx)::DOUBLE AS last, count(*) AS num_elements, 0::BIGINT AS non_finite FROM hourly GROUP BY owner_id, name",
    ),
    "AGG_11_boolean_statistics": _h(
        _booleans,
        "SELECT owner_id, name, count(*) FILTER (WHERE v > 0) AS true_count, count(*) FILTER (WHERE v <= 0) AS false_count FROM hourly GROUP BY ALL",
    ),
    "SRT_3_duration_curve": _h(
        lambda r: charts.duration_curve(r, _OWNER).select(*_OWNER, "rank", F.round("percent", 6).alias("percent"), "v"),
        "SELECT owner_id, name, rn AS rank, round((rn - 1) / 720::DOUBLE * 100, 6) AS percent, v::DOUBLE AS v FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, name ORDER BY v DESC) AS rn FROM hourly)",
    ),
    "SRT_4_sparkline": _h(lambda r: charts.sparkline(r, _OWNER, 60), """SELECT owner_id, name, bucket, arg_max(v::DOUBLE, (abs(v - m), idx)) AS v FROM
        (SELECT owner_id, name, idx, v, avg(v) OVER (PARTITION BY owner_id, name) AS m, ((idx + 1) * 60 - 1) // 720 AS bucket FROM hourly) GROUP BY ALL"""),
    "VIZ_1_line": _h(lambda r: series.steps(r, HOUR, _OWNER).select(*_OWNER, "t", "v"), "SELECT owner_id, name, t, v FROM hourly"),
    "VIZ_3_heatmap": _h(
        lambda r: charts.heatmap(r, _OWNER, HOUR),
        "SELECT owner_id, name, idx % 24 AS row, idx // 24 AS col, v::DOUBLE AS v FROM hourly",
    ),
    "VIZ_4_fan": _h(lambda r: charts.fan(_probabilistic(r.where("name = 'view'")).where("w = 3"), 3).select("target_time", "band", F.round("low", 4).alias("low"), F.round("high", 4).alias("high")), f"""SELECT TIMESTAMP '2024-01-01' + to_hours(idx::INT) AS target_time, band::BIGINT AS band, round(low, 4) AS low, round(high, 4) AS high FROM
        (SELECT idx, unnest([0, 1]) AS band, unnest([q[1], q[2]]) AS low, unnest([q[3], q[2]]) AS high FROM (SELECT idx, quantile_cont(v::DOUBLE, [0.05::DOUBLE, 0.5::DOUBLE, 0.95::DOUBLE]) AS q FROM hourly WHERE name = 'view' AND idx // 24 = 3 GROUP BY idx))"""),
    "VIZ_4_scenario_traces": _h(
        lambda r: charts.traces(_scenarios(r).where("name = 'view' and w = 3")),
        "SELECT t AS target_time, 'scenario ' || (owner_id % 5 + 1) AS trace, sum(v)::BIGINT AS v FROM hourly WHERE name = 'view' AND idx // 24 = 3 GROUP BY ALL",
    ),
    "VIZ_5_overlay": _h(_overlay, f"SELECT owner_id, name, w, h, target_time, v, actual {_OVERLAY}"),
    "JON_9_forecast_vs_actual": _h(
        lambda r: charts.forecast_error(_views(r), _OWNER, HOUR, TWO_DAYS, DAY, 24),
        f"SELECT owner_id, name, sum(v - actual)::BIGINT AS error {_OVERLAY} GROUP BY ALL",
    ),
    "PER_10_precision": (
        (lambda spark, d: fx.table(spark, d, "events").agg(F.count_if(micros(F.col("ts")) % 1000 != 0).alias("finer"))),
        "SELECT count(*) FILTER (WHERE epoch_us(ts) % 1000 <> 0) AS finer FROM events",
    ),
    "ARR_6_tuple": (_pairs, "SELECT vec_id, i::BIGINT AS i, round(embedding[i + 1]::DOUBLE, 6) AS v FROM embeddings, range(64) r(i)"),
    "ARR_7_piecewise_round_trip": (_functions, "SELECT l_orderkey, l_linenumber::DOUBLE AS x, l_quantity AS y FROM lineitem"),
}
