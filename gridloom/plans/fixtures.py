"""Series, links and catalogs from the shared tables, the same in DataFrames and in SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.period import EPOCH, Period, micros  # noqa: F401
from ..functions.period_columns import let
from ..operators.filters import feature_value
from ..schema import FEATURE

T0 = dt.datetime(2024, 1, 1)
HOURS, MONTHS = 720, 80
HOUR, DAY = Period.parse("PT1H"), Period.parse("PT24H")
MONTH = Period.parse("P1M")
M0 = dt.datetime(1995, 1, 1)
#: Types of events, which name the hourly series.
EVENTS = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ntz(t: dt.datetime) -> Column:
    return F.lit(t).cast("timestamp_ntz")


def _filled(cells: Column, n: int) -> Column:
    """An array of n values from (idx, v) entries, 0 where there is none."""
    zeros = lambda k: F.array_repeat(F.lit(0).cast("long"), k.cast("int"))
    inside = F.array_sort(F.filter(cells, lambda x: x["idx"].between(0, n - 1)))

    def runs(held):
        """Each entry behind the zeros since the one before, and the zeros after the last."""
        before = lambda i: F.coalesce(F.get(held, i - 1)["idx"], F.lit(-1).cast("long"))
        parts = F.transform(held, lambda x, i: F.concat(zeros(x["idx"] - before(i) - 1), F.array(F.coalesce(x["v"], F.lit(0).cast("long")))))
        return F.concat(F.flatten(parts), zeros(n - 1 - before(F.size(held))))

    return let(inside, runs)


def hourly(spark: SparkSession, d: str) -> DataFrame:
    """(owner_id, name, initial_timestamp, length, values): cents by hour for each user and event type."""
    e = table(spark, d, "events")
    idx = F.floor((micros(F.col("ts")) - F.lit(int((T0 - EPOCH).total_seconds()) * 1_000_000)) / 3_600_000_000).cast("long")
    cents = F.round(F.col("value") * 100).cast("long")
    cells = e.select(
        F.col("user_id").alias("owner_id"),
        F.col("event_type").alias("name"),
        idx.alias("idx"),
        cents.alias("c"),
    ).where(F.col("idx").between(0, HOURS - 1))
    cells = cells.groupBy("owner_id", "name", "idx").agg(F.sum("c").alias("v"))
    out = cells.groupBy("owner_id", "name").agg(_filled(F.collect_list(F.struct("idx", "v")), HOURS).alias("values"))
    return out.select("owner_id", "name", ntz(T0).alias("initial_timestamp"), F.lit(HOURS).cast("long").alias("length"), "values")


def monthly(spark: SparkSession, d: str) -> DataFrame:
    """Cents by month for each order priority."""
    o = table(spark, d, "orders")
    at = F.col("o_orderdate")
    idx = ((F.year(at) - 1995) * 12 + F.month(at) - 1).cast("long")
    cells = o.select(F.col("o_orderpriority").alias("name"), idx.alias("idx"), F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    cells = cells.groupBy("name", "idx").agg(F.sum("c").alias("v"))
    out = cells.groupBy("name").agg(_filled(F.collect_list(F.struct("idx", "v")), MONTHS).alias("values"))
    return out.select("name", ntz(M0).alias("initial_timestamp"), F.lit(MONTHS).cast("long").alias("length"), "values")


def irregular(spark: SparkSession, d: str) -> DataFrame:
    """(owner_id, timestamps, values): each user's events at whole milliseconds."""
    e = table(spark, d, "events")
    ms = F.timestamp_millis(F.floor(micros(F.col("ts")) / 1000)).cast("timestamp_ntz")
    rows = e.select(F.col("user_id").alias("owner_id"), ms.alias("t"), F.round(F.col("value") * 100).cast("long").alias("v"))
    pairs = rows.groupBy("owner_id").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("p"))
    return pairs.select("owner_id", F.col("p.t").alias("timestamps"), F.col("p.v").alias("values"), F.size("p").cast("long").alias("length"))


def associations(spark: SparkSession, d: str) -> DataFrame:
    """Catalog rows of the series above, of views on those of even users and of dense forecasts of some odd ones."""
    e = table(spark, d, "events")
    single = e.select(F.col("user_id").alias("owner_id"), F.col("event_type").alias("name")).distinct()
    own = F.sha2(F.concat(F.lit("ts:"), F.col("owner_id").cast("string"), F.lit(":"), F.col("name")), 256)
    null = F.lit(None)
    users = {
        "owner_type": F.element_at(F.array(F.lit("Generator"), F.lit("Load"), F.lit("Storage")), (F.col("owner_id") % 3 + 1).cast("int")),
        "owner_category": F.when(F.col("owner_id") % 4 == 0, "SupplementalAttribute").otherwise("Component"),
        "component_field": F.when(F.col("owner_id") % 2 == 0, "max_active_power"),
        "year": (2024 + F.col("owner_id") % 2).cast("long"),
        "segment": F.char(97 + F.col("owner_id") % 5),
    }
    grid = {"initial_timestamp": ntz(T0), "resolution": F.lit("PT1H"), "length": F.lit(HOURS)}
    none = {"horizon": null, "interval": null, "count": null, "timestamps_hash": null}

    def rows(df, code, **cols):
        merged = users | grid | none | {"data_hash": own} | cols
        names = [
            "owner_id",
            "name",
            "owner_type",
            "owner_category",
            "component_field",
            "year",
            "segment",
            "initial_timestamp",
            "resolution",
            "length",
            "horizon",
            "interval",
            "count",
            "timestamps_hash",
            "data_hash",
        ]
        types = {"length": "long", "count": "long", "year": "long", "initial_timestamp": "timestamp_ntz"}
        return df.select(
            F.lit(code).alias("time_series_type"),
            *[(merged[n] if n in merged else F.col(n)).cast(types.get(n, "long" if n == "owner_id" else "string")).alias(n) for n in names],
        )

    vectors = e.groupBy(F.col("user_id").alias("owner_id")).agg(F.count(F.lit(1)).alias("n"))
    axis = F.sha2(F.concat(F.lit("axis:"), F.col("owner_id").cast("string")), 256)
    view = {"horizon": F.lit("P2D"), "interval": F.lit("P1D"), "count": F.lit(29)}
    dense = {"horizon": F.lit("P1D"), "interval": F.lit("P1D"), "count": F.lit(30), "length": F.lit(24)}
    priorities = table(spark, d, "orders").select(F.col("o_orderpriority").alias("name")).distinct()
    out = rows(single, 0)
    out = out.union(
        rows(vectors.withColumn("name", F.lit("activity")), 1, length=F.col("n"), timestamps_hash=axis, resolution=null, initial_timestamp=null),
    )
    out = out.union(rows(single.where("owner_id % 2 = 0"), 3, **view))
    out = out.union(
        rows(
            single.where("owner_id % 14 = 1"),
            2,
            data_hash=F.sha2(F.concat(F.lit("det:"), F.col("owner_id").cast("string"), F.lit(":"), F.col("name")), 256),
            **dense,
        ),
    )
    months = {
        "owner_type": F.lit("Market"),
        "owner_category": F.lit("Component"),
        "component_field": null,
        "year": null,
        "segment": null,
        "initial_timestamp": ntz(M0),
        "resolution": F.lit("P1M"),
        "length": F.lit(MONTHS),
    }
    out = out.union(rows(priorities.withColumn("owner_id", 1_000_000 + F.substring("name", 1, 1).try_cast("long")), 0, **months))
    pair = F.create_map(
        F.lit("year"),
        F.struct(
            F.lit("int").alias("kind"),
            F.col("year").alias("i"),
            F.lit(None).cast("double").alias("f"),
            F.lit(None).cast("boolean").alias("b"),
            F.lit(None).cast("string").alias("s"),
        ),
        F.lit("segment"),
        F.struct(
            F.lit("str").alias("kind"),
            F.lit(None).cast("long").alias("i"),
            F.lit(None).cast("double").alias("f"),
            F.lit(None).cast("boolean").alias("b"),
            F.col("segment").alias("s"),
        ),
    )
    features = F.when(F.col("year").isNull(), F.expr(f"cast(map() as map<string,{FEATURE}>)")).otherwise(pair.cast(f"map<string,{FEATURE}>"))
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("year").cast("string"), F.lit("-")), F.coalesce("segment", F.lit("-"))), 256)
    # an id that grows with (type, owner, name) and needs no global order
    number = F.col("time_series_type") * 100_000_000 + F.col("owner_id") * 10 + F.coalesce(
        F.array_position(F.array(*map(F.lit, ("activity", "click", "error", "purchase", "signup", "view"))), F.col("name")),
        F.lit(0),
    )
    return out.withColumns(
        {
            "features": features,
            "features_hash": key,
            "assoc_id": number.cast("long"),
            "element_type": F.lit("f64"),
            "element_shape": F.expr("cast(array() as array<int>)"),
        },
    )


def dense(rows: DataFrame) -> DataFrame:
    """Hourly series as forecasts [24, 30]: window c has the hours of day c."""
    of = lambda v: F.transform(F.sequence(F.lit(0), F.lit(719)), lambda i: F.get(v, (i % 30) * 24 + F.floor(i / 30).cast("int")))
    return rows.withColumn("values", F.element_at(F.transform(F.array("values"), of), 1))


def arrays(spark: SparkSession, d: str) -> DataFrame:
    """(data_hash, dtype, shape, values, exact) of every row of associations()."""
    key = lambda *parts: F.sha2(F.concat(*[F.lit(p) if p[-1:] == ":" else F.col(p).cast("string") for p in parts]), 256)
    singles = hourly(spark, d)
    forecasts = dense(singles.where("owner_id % 14 = 1"))
    market = monthly(spark, d).withColumn("owner_id", 1_000_000 + F.substring("name", 1, 1).try_cast("long"))
    own = [
        (singles, key("ts:", "owner_id", ":", "name"), F.array("length")),
        (forecasts, key("det:", "owner_id", ":", "name"), F.array(F.lit(24), F.lit(30))),
        (market, key("ts:", "owner_id", ":", "name"), F.array("length")),
        (irregular(spark, d).withColumn("name", F.lit("activity")), key("ts:", "owner_id", ":", "name"), F.array("length")),
    ]
    out = None
    for rows, data_hash, shape in own:
        columns = [data_hash.alias("data_hash"), F.lit("f64").alias("dtype"), shape.cast("array<int>").alias("shape")]
        values = F.col("values").cast("array<double>").alias("values")
        part = rows.select(*columns, values, F.lit(None).cast("array<decimal(20,0)>").alias("exact"))
        out = part if out is None else out.union(part)
    return out


def timestamp_sets(spark: SparkSession, d: str) -> DataFrame:
    """(timestamps_hash, timestamps) of the irregular series."""
    axis = F.sha2(F.concat(F.lit("axis:"), F.col("owner_id").cast("string")), 256)
    return irregular(spark, d).select(axis.alias("timestamps_hash"), "timestamps")


def attribute_links(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers with the parts they deliver."""
    pairs = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("component_id"), F.col("l_partkey").alias("attribute_id")).distinct()
    kind = lambda name, c, n: F.concat(F.lit(name), (F.col(c) % n).cast("string"))
    return pairs.select(
        (F.col("component_id") * 1_000_000 + F.col("attribute_id")).alias("id"),
        "component_id",
        kind("Supplier", "component_id", 2).alias("component_type"),
        "attribute_id",
        kind("Part", "attribute_id", 3).alias("attribute_type"),
    )


def component_edges(spark: SparkSession, d: str) -> DataFrame:
    """Regions over nations over customers and suppliers."""
    n, c, s = (table(spark, d, x) for x in ("nation", "customer", "supplier"))

    def edges(df, parent, parent_type, child, child_type):
        return df.select(
            parent.cast("long").alias("parent_id"),
            F.lit(parent_type).alias("parent_type"),
            child.cast("long").alias("child_id"),
            F.lit(child_type).alias("child_type"),
        )

    out = edges(n, F.col("n_regionkey"), "Region", 100 + F.col("n_nationkey"), "Nation")
    out = out.union(edges(c, 100 + F.col("c_nationkey"), "Nation", 10_000_000 + F.col("c_custkey"), "Customer"))
    out = out.union(edges(s, 100 + F.col("s_nationkey"), "Nation", 20_000_000 + F.col("s_suppkey"), "Supplier"))
    return out.select((F.col("parent_id") * 100_000_000 + F.col("child_id")).alias("id"), "*")


def feature_of_year(y: int) -> Column:
    return feature_value(y)


SQL_HOURLY = """
cells AS (SELECT user_id AS owner_id, event_type AS name, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000 AS idx, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS v
          FROM events GROUP BY ALL),
hourly AS (SELECT u.owner_id, u.name, i.idx::BIGINT AS idx, TIMESTAMP '2024-01-01' + to_hours(i.idx::INT) AS t, coalesce(c.v, 0)::BIGINT AS v
           FROM (SELECT DISTINCT owner_id, name FROM cells WHERE idx BETWEEN 0 AND 719) u CROSS JOIN range(720) i(idx)
           LEFT JOIN cells c ON c.owner_id = u.owner_id AND c.name = u.name AND c.idx = i.idx)"""
SQL_MONTHLY = """
mcells AS (SELECT o_orderpriority AS name, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS idx, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS v FROM orders GROUP BY ALL),
monthly AS (SELECT u.name, i.idx::BIGINT AS idx, TIMESTAMP '1995-01-01' + to_months(i.idx::INT) AS t, coalesce(c.v, 0)::BIGINT AS v
            FROM (SELECT DISTINCT name FROM mcells) u CROSS JOIN range(80) i(idx) LEFT JOIN mcells c ON c.name = u.name AND c.idx = i.idx)"""
SQL_IRREGULAR = """
activity AS (SELECT user_id AS owner_id, date_trunc('millisecond', ts) AS t, CAST(round(value * 100) AS BIGINT) AS v FROM events)"""
_USER = """['Generator', 'Load', 'Storage'][owner_id % 3 + 1] AS owner_type, CASE WHEN owner_id % 4 = 0 THEN 'SupplementalAttribute' ELSE 'Component' END AS owner_category,
CASE WHEN owner_id % 2 = 0 THEN 'max_active_power' END AS component_field, 2024 + owner_id % 2 AS year, chr((97 + owner_id % 5)::INT) AS segment"""
SQL_ASSOC = f"""
single AS (SELECT DISTINCT user_id AS owner_id, event_type AS name FROM events),
parts AS (
  SELECT 0 AS time_series_type, owner_id, name, {_USER}, TIMESTAMP '2024-01-01' AS initial_timestamp, 'PT1H' AS resolution, 720 AS length, NULL AS horizon, NULL AS "interval", NULL AS "count",
         NULL AS timestamps_hash, sha256('ts:' || owner_id || ':' || name) AS data_hash FROM single
  UNION ALL SELECT 1, owner_id, 'activity', {_USER}, NULL, NULL, n, NULL, NULL, NULL, sha256('axis:' || owner_id), sha256('ts:' || owner_id || ':activity')
         FROM (SELECT user_id AS owner_id, count(*) AS n FROM events GROUP BY user_id)
  UNION ALL SELECT 3, owner_id, name, {_USER}, TIMESTAMP '2024-01-01', 'PT1H', 720, 'P2D', 'P1D', 29, NULL, sha256('ts:' || owner_id || ':' || name) FROM single WHERE owner_id % 2 = 0
  UNION ALL SELECT 2, owner_id, name, {_USER}, TIMESTAMP '2024-01-01', 'PT1H', 24, 'P1D', 'P1D', 30, NULL, sha256('det:' || owner_id || ':' || name) FROM single WHERE owner_id % 14 = 1
  UNION ALL SELECT 0, 1000000 + CAST(name[1] AS BIGINT), name, 'Market', 'Component', NULL, NULL, NULL, TIMESTAMP '1995-01-01', 'P1M', 80, NULL, NULL, NULL, NULL, sha256('ts:' || (1000000 + CAST(name[1] AS BIGINT)) || ':' || name)
         FROM (SELECT DISTINCT o_orderpriority AS name FROM orders)),
assoc AS (SELECT time_series_type * 100000000 + owner_id * 10 + coalesce(list_position(['activity', 'click', 'error', 'purchase', 'signup', 'view'], name), 0) AS assoc_id, *,
          sha256(coalesce(year::VARCHAR, '-') || ':' || coalesce(segment, '-')) AS features_hash FROM parts)"""
SQL_LINKS = """
links AS (SELECT component_id * 1000000 + attribute_id AS id, component_id, 'Supplier' || component_id % 2 AS component_type, attribute_id, 'Part' || attribute_id % 3 AS attribute_type
          FROM (SELECT DISTINCT l_suppkey AS component_id, l_partkey AS attribute_id FROM lineitem))"""
SQL_EDGES = """
edges AS (SELECT parent_id * 100000000 + child_id AS id, * FROM (
  SELECT n_regionkey::BIGINT AS parent_id, 'Region' AS parent_type, (100 + n_nationkey)::BIGINT AS child_id, 'Nation' AS child_type FROM nation
  UNION ALL SELECT (100 + c_nationkey)::BIGINT, 'Nation', 10000000 + c_custkey, 'Customer' FROM customer
  UNION ALL SELECT (100 + s_nationkey)::BIGINT, 'Nation', 20000000 + s_suppkey, 'Supplier' FROM supplier))"""
