"""A store of series: one folder of Parquet files for each table, or tables in memory.

Adding appends files: arrays and timestamp vectors first, the catalog's rows last, so no row names an array that is not
there. Removing and renaming rewrite the catalog alone; arrays that nothing refers to any more go with sweep(). What
is added is hashed once, as a written table. Each change is checked before anything is written.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..errors import DuplicateTimeSeries, IntegrityError, InvalidParameter, NotFound, ReadOnlyStore, StoreExists
from ..functions.elements import ElementType
from ..functions.hashing import content_hash, features_hash, timestamps_hash_column
from ..functions.parse import DERIVED, DETERMINISTIC, IRREGULAR, PROBABILISTIC, SCENARIOS, SINGLE
from ..functions.period import Period, instant, whole_millis
from ..functions.tables import ARRAY_ROWS, held, written
from ..operators import catalog, diagnostics, links, merging, ranges, series, sets
from ..operators.filters import ListFilter, resolve_one
from ..schema import FEATURE, RESERVED_FEATURES, TABLES
from . import files


@dataclass
class Request:
    """One series to add: values in row-major order, the shape of the whole array, time first."""

    owner_id: int
    owner_type: str
    name: str
    values: list
    owner_category: str = "Component"
    time_series_type: int = SINGLE
    shape: list[int] | None = None
    element_type: str = "f64"
    initial_timestamp: dt.datetime | None = None
    resolution: str | None = None
    horizon: str | None = None
    interval: str | None = None
    count: int | None = None
    timestamps: list[dt.datetime] | None = None
    percentiles: list[float] | None = None
    features: dict = field(default_factory=dict)
    units: str | None = None
    quantity_kind: str | None = None
    unit_system: str | None = None
    component_field: str | None = None
    application_data: str | None = None


#: What add_frame() takes; values of 64-bit integer types may come in exact instead.
INCOMING = f"""owner_id bigint, owner_type string, owner_category string, time_series_type int, name string, initial_timestamp timestamp_ntz, resolution string,
horizon string, interval string, count bigint, percentiles array<double>, timestamps array<timestamp_ntz>, element_type string, shape array<int>, values array<double>,
exact array<decimal(20,0)>, features map<string,{FEATURE}>, units string, quantity_kind string, unit_system string, component_field string, application_data string"""
#: Axes before the values of one step, by type (fixed values).
LEADING = {SINGLE: 1, IRREGULAR: 1, DETERMINISTIC: 2, DERIVED: 1, PROBABILISTIC: 3, SCENARIOS: 3}
WRITABLE = (SINGLE, IRREGULAR, DETERMINISTIC, PROBABILISTIC, SCENARIOS)


def _python_features(items) -> dict:
    of = {"int": lambda x: int(x["i"]), "float": lambda x: float(x["f"]), "bool": lambda x: bool(x["b"]), "str": lambda x: x["s"]}
    return {k: of[v["kind"]](v) for k, v in items}


@F.arrow_udf(StringType())
def hash_features(features: pa.Array) -> pa.Array:
    pairs = [[(x["key"], x["value"]) for x in row] for row in features.to_pylist()]
    return pa.array([features_hash(_python_features(p)) for p in pairs], pa.string())


def _period_n(known: list[str]) -> Column:
    """The number of months or milliseconds of a period, from the few texts that stand in the batch."""
    return F.coalesce(F.lit(None).cast("long"), *[F.when(F.col("resolution") == t, F.lit(Period.parse(t).n).cast("long")) for t in known])


def _dtype(element: Column, known: list[str]) -> Column:
    return F.coalesce(*[F.when(element == t, F.lit(ElementType.parse(t).dtype)) for t in known])


def _known_types(incoming: DataFrame) -> list[str]:
    """The element types of a batch, which are few; an unknown one is an error."""
    known = [r[0] for r in incoming.select("element_type").distinct().collect()]
    for text in known:
        ElementType.parse(text)
    return known


class Store:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], path: str | None = None, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, path, read_only
        self.tables = tables

    # opening
    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None, replace: bool = False) -> Store:
        """A new store; in memory without a path. An existing one is refused unless it is to be replaced."""
        empty = {k: spark.createDataFrame([], s) for k, s in TABLES.items()}
        if path is None:
            return cls(spark, empty)
        if files.exists(spark, f"{path}/associations"):
            if not replace:
                raise StoreExists(path)
            files.delete(spark, path)
        for name, table in empty.items():
            table.write.parquet(f"{path}/{name}")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str, read_only: bool = False) -> Store:
        if not files.exists(spark, f"{path}/associations"):
            raise NotFound(f"no store at {path}")
        return cls(spark, {k: cls._read(spark, path, k) for k in TABLES}, path, read_only)

    @staticmethod
    def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
        return spark.read.schema(TABLES[name]).parquet(f"{path}/{name}")

    @property
    def associations(self) -> DataFrame:
        return self.tables["associations"]

    def _writable(self) -> None:
        if self.read_only:
            raise ReadOnlyStore(self.path or "")

    def _append(self, **new: DataFrame) -> None:
        """Rows added to tables, in the order given."""
        self._writable()
        for name, rows in new.items():
            if self.path is None:
                self.tables[name] = self.tables[name].unionByName(written(rows, name))
            else:
                if name == "associations":
                    rows = rows.sortWithinPartitions("time_series_type", "owner_category", "owner_id", "name")
                rows.select(*self.tables[name].columns).write.mode("append").parquet(f"{self.path}/{name}")
                self.tables[name] = self._read(self.spark, self.path, name)

    def _change(self, **tables: DataFrame) -> None:
        """Whole tables anew; on disk they are written aside first, as they are made from what they replace."""
        self._writable()
        for name, table in tables.items():
            if self.path is not None:
                written(table, name).write.mode("overwrite").parquet(f"{self.path}/{name}")
                table = self._read(self.spark, self.path, name)
            self.tables[name] = table

    # adding
    def add(self, *requests: Request, replace: bool = False) -> None:
        """All requests or none; with replace, series of the same identities go in the same step."""
        rows = []
        for r in requests:
            exact = [int(v) for v in r.values] if ElementType.parse(r.element_type).dtype in ("i64", "u64") else None
            feature = {k: _stored(v) for k, v in r.features.items()}
            text = lambda p: Period.parse(p).iso() if p is not None else None
            values = None if exact is not None else [float(v) for v in r.values]
            shape = r.shape if r.shape is not None else [len(r.values)]
            rows.append(
                (
                    r.owner_id,
                    r.owner_type,
                    r.owner_category,
                    r.time_series_type,
                    r.name,
                    r.initial_timestamp,
                    text(r.resolution),
                    text(r.horizon),
                    text(r.interval),
                    r.count,
                    r.percentiles,
                    r.timestamps,
                    str(ElementType.parse(r.element_type)),
                    shape,
                    values,
                    exact,
                    feature,
                    r.units,
                    r.quantity_kind,
                    r.unit_system,
                    r.component_field,
                    r.application_data,
                ),
            )
        self.add_frame(self.spark.createDataFrame([tuple(_decimals(x) if i == 15 else x for i, x in enumerate(r)) for r in rows], INCOMING), replace)

    def add_frame(self, incoming: DataFrame, replace: bool = False) -> None:
        """Rows of INCOMING: checked, hashed (once, then kept) and stored; arrays and timestamp vectors once each."""
        known = _known_types(incoming)
        n = F.coalesce(F.size("exact"), F.size("values"))
        rows = incoming.withColumn("dtype", _dtype(F.col("element_type"), known) if known else F.lit("f64"))
        vector = timestamps_hash_column(F.coalesce("timestamps", F.expr("cast(array() as array<timestamp_ntz>)")))
        # hashed in one step, so that a row with its array goes by Python once
        rows = rows.withColumns(
            {
                "data_hash": content_hash(*map(F.col, ("dtype", "shape", "values", "exact"))),
                "features_hash": hash_features(F.array_sort(F.map_entries("features"))),
                "timestamps_hash": F.when(F.col("timestamps").isNotNull(), vector),
                "__n": n,
            }
        )
        self._add_hashed(written(rows.withColumn("__row", F.monotonically_increasing_id()), "incoming", ARRAY_ROWS), known, replace)

    def _add_hashed(self, rows: DataFrame, known: list[str], replace: bool) -> None:
        problem = F.coalesce(self._problems(rows), self._misshapen(known))
        bad = rows.select("name", "owner_id", problem.alias("problem")).where("problem is not null").limit(1).collect()
        if bad:
            raise InvalidParameter(f"{bad[0]['owner_id']}/{bad[0]['name']}: {bad[0]['problem']}")
        first = (self.associations.agg(F.max("assoc_id")).first()[0] or 0) + 1
        length = F.col("shape")[0].cast("long")
        months = F.col("resolution").rlike(r"^-?P[0-9]+[YM]$")
        known_periods = [r[0] for r in rows.select("resolution").where("resolution is not null").distinct().collect()]
        new = rows.select(
            (F.lit(first) + F.col("__row")).alias("assoc_id"),
            "owner_id", "owner_type", "owner_category", "time_series_type", "name", "initial_timestamp", "resolution",
            F.when(months, "months").when(
                F.col("resolution").isNotNull(),
                "fixed",
            ).alias("resolution_kind"), _period_n(known_periods).alias("resolution_n"),
            length.alias("length"), "horizon", "interval", "count", "timestamps_hash", "units", "quantity_kind", "unit_system", "component_field", "percentiles", "element_type",
            F.slice(
                "shape",
                2,
                F.greatest(F.size("shape") - 1, F.lit(0)),
            ).alias("element_shape"), "application_data", "features", "features_hash", "data_hash",
        )
        held = self.associations
        if replace:
            held = held.alias("l").join(new.alias("r"), sets._same("l", "r"), "left_anti").select("l.*")
        if sets.duplicates(new, held).limit(1).count():
            raise DuplicateTimeSeries("a series of this identity exists")
        if sets.family_conflicts(new, held.unionByName(new)).limit(1).count():
            raise DuplicateTimeSeries("a forecast of this family is stored the other way")
        once = sets.first_rows(rows).join(self.tables["arrays"].select("data_hash"), "data_hash", "left_anti")
        arrays = sets.chosen(rows.select("data_hash", "dtype", "shape", "values", "exact", "__row"), once).drop("__row")
        vectors = rows.where(F.col("timestamps").isNotNull()).select("timestamps_hash", "timestamps").dropDuplicates(["timestamps_hash"])
        vectors = vectors.join(self.tables["timestamp_sets"].select("timestamps_hash"), "timestamps_hash", "left_anti")
        new = written(new, "new")
        if replace:
            self._change(associations=held)
        self._append(arrays=arrays, timestamp_sets=vectors, associations=new)

    @staticmethod
    def _misshapen(known: list[str]) -> Column:
        """A series whose steps do not have the shape that its element type asks for."""
        wrong = F.lit(False)
        axes = F.element_at(F.create_map(*[x for k, n in LEADING.items() for x in (F.lit(k), F.lit(n))]), F.col("time_series_type"))
        step = F.slice("shape", axes + 1, F.greatest(F.size("shape") - axes, F.lit(0)))
        for text in known:
            e = ElementType.parse(text)
            if e.kind == "scalar":
                continue
            n = F.element_at(step, -1)
            fits = (n % 2 == 1) if e.kind == "piecewise_linear" else (n == 1) | ((n >= 2) & (n % 2 == 0)) if e.ragged else n == e.fixed_dims
            wrong = wrong | ((F.col("element_type") == text) & ~F.coalesce((F.size(step) == 1) & fits, F.lit(False)))
        return F.when(wrong, F.lit("the steps do not have the shape of their element type"))

    @staticmethod
    def problems(incoming: DataFrame) -> DataFrame:
        """incoming (rows of INCOMING) with column problem: the first rule that a row breaks, or null. Nothing is hashed or stored."""
        known = _known_types(incoming)
        rows = incoming.withColumn("__n", F.coalesce(F.size("exact"), F.size("values")))
        return rows.withColumn("problem", F.coalesce(Store._problems(rows), Store._misshapen(known))).drop("__n")

    @staticmethod
    def _problems(rows: DataFrame) -> Column:
        """The first rule that a row breaks, else null."""
        t = F.col("time_series_type")
        regular = t != IRREGULAR
        forecast = t.isin(DETERMINISTIC, PROBABILISTIC, SCENARIOS)
        product = F.aggregate("shape", F.lit(1), lambda a, x: a * x)
        increasing = F.forall(F.sequence(F.lit(0), F.size("timestamps") - 2), lambda i: F.get("timestamps", i) < F.get("timestamps", i + 1))
        rising = F.forall(F.sequence(F.lit(0), F.size("percentiles") - 2), lambda i: F.get("percentiles", i) < F.get("percentiles", i + 1))
        wrong_value = lambda k, v: (v["kind"] == "float") & (F.isnan(v["f"]) | ((v["f"] == 0) & (v["f"].cast("string") == "-0.0")))
        rules = [
            (~t.isin(*WRITABLE), "this type cannot be written"),
            (product != F.col("__n"), "the shape does not fit the values"),
            (F.arrays_overlap(F.map_keys("features"), F.array(*map(F.lit, sorted(RESERVED_FEATURES)))), "a feature has a reserved name"),
            (F.exists(F.map_entries("features"), lambda x: wrong_value(x["key"], x["value"])), "a feature is NaN or -0.0"),
            (regular & (F.col("initial_timestamp").isNull() | F.col("resolution").isNull()), "initial timestamp and resolution are needed"),
            (regular & ~whole_millis(F.col("initial_timestamp")), "instants are whole milliseconds"),
            (F.col("resolution").rlike("^-|^PT0S$"), "the resolution must be positive"),
            (~regular & (F.col("timestamps").isNull() | (F.size("timestamps") != F.col("shape")[0])), "one timestamp for each step is needed"),
            (~regular & F.col("resolution").isNotNull(), "an irregular series has no resolution"),
            (~regular & (F.size("timestamps") > 1) & ~increasing, "timestamps must increase"),
            (~regular & F.exists("timestamps", lambda x: ~whole_millis(x)), "instants are whole milliseconds"),
            (forecast & (F.col("horizon").isNull() | F.col("interval").isNull() | F.col("count").isNull()), "horizon, interval and count are needed"),
            ((t == DETERMINISTIC) & (F.get("shape", F.lit(1)) != F.col("count")), "the second axis is the count"),
            (t.isin(PROBABILISTIC, SCENARIOS) & (F.get("shape", F.lit(2)) != F.col("count")), "the third axis is the count"),
            (forecast & (F.col("interval") == "PT0S") & (F.col("count") > 1), "a zero interval has one window"),
            (
                (t == PROBABILISTIC) & (F.col("percentiles").isNull() | (F.size("percentiles") != F.col("shape")[0])),
                "one percentile for each of the first axis is needed",
            ),
            ((t == PROBABILISTIC) & (F.size("percentiles") > 1) & ~rising, "percentiles must increase"),
        ]
        return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for c, m in rules])

    # reading
    def list(self, f: ListFilter = ListFilter()) -> DataFrame:
        return catalog.list_series(self.associations, self.tables["timestamp_sets"], f)

    def read(self, f: ListFilter = ListFilter()) -> DataFrame:
        """Catalog rows with dtype, shape and values, and timestamps of irregular series; the filtered catalog is the small side."""
        return self.list(f).join(self.tables["arrays"], "data_hash")

    def array(self, data_hash: str) -> DataFrame:
        """The array of a hash, with shape and the element type of a series that refers to it; one that nothing refers to is not found."""
        types = self.associations.where(F.col("data_hash") == data_hash).select("element_type").limit(1).collect()
        if not types:
            raise NotFound(f"no series refers to {data_hash}")
        return self.tables["arrays"].where(F.col("data_hash") == data_hash).withColumn("element_type", F.lit(types[0][0]))

    def array_shapes(self) -> DataFrame:
        """(data_hash, dtype, shape) without reading values."""
        return self.tables["arrays"].select("data_hash", "dtype", "shape")

    def timestamps(self, timestamps_hash: str) -> DataFrame:
        """The instants of a vector, in order."""
        return self.tables["timestamp_sets"].where(F.col("timestamps_hash") == timestamps_hash).select(F.posexplode("timestamps").alias("i", "t"))

    def read_range(self, keys: DataFrame, on: list[str], start: dt.datetime, end: dt.datetime) -> DataFrame:
        """Single series of keys (ordinal, *on), cut to [start, end), one row a key; all of one resolution, and none may be missing."""
        singles = self.associations.where(F.col("time_series_type") == SINGLE)
        rows = catalog.metadata_of(singles, keys, on)
        periods = [r[0] for r in rows.select("resolution").distinct().limit(2).collect()]
        if len(periods) != 1:
            raise InvalidParameter("the series do not share one resolution")
        return series.slice_regular(rows.join(self.tables["arrays"], "data_hash"), Period.parse(periods[0]), start, end)

    def read_ranges(self, keys: DataFrame, on: list[str], start: dt.datetime, end: dt.datetime) -> DataFrame:
        """Series of any type and resolution of keys (ordinal, *on), cut to [start, end), one row a key; none may be missing."""
        return ranges.read_ranges(keys, on, self.associations, self.tables["arrays"], self.tables["timestamp_sets"], instant(start), instant(end))

    def get(self, f: ListFilter, start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
        """The one series of f, whole or sliced."""
        row = resolve_one(self.associations, f)
        rows = self.read(f)
        if start is None or end is None:
            return rows
        if row["time_series_type"] == SINGLE:
            width = 1
            for x in row["element_shape"]:
                width *= x
            return series.slice_regular(rows, Period.parse(row["resolution"]), start, end, width)
        if row["time_series_type"] == IRREGULAR:
            return series.slice_irregular(rows, start, end)
        raise InvalidParameter("forecasts are read by windows")

    def windows(self, f: ListFilter, start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
        """Windows of the one forecast of f, however it is stored."""
        row = catalog.resolve_forecast(self.associations, f)
        resolution, horizon, interval = (Period.parse(row[c]) for c in ("resolution", "horizon", "interval"))
        chosen = series.resolve_windows(row["initial_timestamp"], interval, row["count"], start, end)
        rows = self.read(
            ListFilter(
                owner_id=row["owner_id"],
                owner_category=row["owner_category"],
                name=row["name"],
                time_series_type=row["time_series_type"],
                exact_type=True,
                resolution=row["resolution"],
                interval=row["interval"],
                features_hash=row["features_hash"],
            ),
        )
        if row["time_series_type"] == DERIVED:
            return series.derived_windows(rows, ["owner_id", "name"], horizon, interval, resolution, windows=chosen)
        return series.dense_windows(rows, ["owner_id", "name"], resolution.divide_into(horizon), resolution, interval, windows=chosen)

    # changing
    def merge(self, other: Store, f: ListFilter = ListFilter(), replace: bool = False) -> int:
        """The series of another store that match, views as dense forecasts; how many came. An identity that is there is an error, or replaced."""
        chosen = merging.Catalog(f.of(other.associations), other.tables["arrays"])
        own = merging.Catalog(self.associations, self.tables["arrays"])
        kept, new = merging.parts(own, chosen, replace)
        first = (self.associations.agg(F.max("assoc_id")).first()[0] or 0) + 1
        rows = written(new.associations.withColumn("assoc_id", F.lit(first) + F.monotonically_increasing_id()), "merged")
        arrays = new.arrays.join(held(self.tables["arrays"].select("data_hash")), "data_hash", "left_anti")
        vectors = other.tables["timestamp_sets"].join(rows.select("timestamps_hash").distinct(), "timestamps_hash", "left_semi")
        vectors = vectors.join(self.tables["timestamp_sets"].select("timestamps_hash"), "timestamps_hash", "left_anti")
        if replace:
            self._change(associations=kept)
        self._append(arrays=arrays, timestamp_sets=vectors, associations=rows)
        return rows.count()

    def _left(self, left: DataFrame) -> None:
        """Only the rows left stay; a view must not lose the series that it shows."""
        if sets.orphaned_views(left).limit(1).count():
            raise IntegrityError("a derived view would lose its series")
        self._change(associations=left)

    def remove(self, f: ListFilter, at_least: int = 0) -> int:
        """Series that match go. Their arrays stay until sweep()."""
        match = F.coalesce(f.column(), F.lit(False))
        n = self.associations.where(match).count()
        if n < at_least:
            raise NotFound("no such series")
        self._left(self.associations.where(~match))
        return n

    def remove_each(self, filters: list[ListFilter]) -> int:
        """The one series of each filter goes, or nothing does; the catalog is read once for all filters."""
        if not filters:
            return 0
        matched = F.array_compact(F.array(*[F.when(F.coalesce(f.column(), F.lit(False)), F.lit(i)) for i, f in enumerate(filters)]))
        found = self.associations.select("assoc_id", F.explode(matched).alias("i")).groupBy("i")
        of = {r["i"]: r for r in found.agg(F.count(F.lit(1)).alias("n"), F.min("assoc_id").alias("id")).collect()}
        for i, f in enumerate(filters):
            if i not in of or of[i]["n"] > 1:
                resolve_one(self.associations, f)  # says which series, or that there is none
        ids = sorted({r["id"] for r in of.values()})
        gone = self.spark.createDataFrame([(i,) for i in ids], "assoc_id long")
        self._left(self.associations.join(F.broadcast(gone), "assoc_id", "left_anti").select(*self.associations.columns))
        return len(ids)

    def sweep(self) -> dict[str, int]:
        """Arrays and timestamp vectors that no series refers to go; how many."""
        gone = {}
        for name, key in (("arrays", "data_hash"), ("timestamp_sets", "timestamps_hash")):
            gone[name] = sets.orphans(self.tables[name], self.associations, key).count()
            if gone[name]:
                kept = self.tables[name].join(self.associations.select(key).distinct(), key, "left_semi")
                self._change(**{name: kept.select(*self.tables[name].columns)})
        return gone

    def clear(self, owner_id: int | None = None, category: str | None = None) -> None:
        """One owner or everything, without the guard for views."""
        if owner_id is None:
            self._change(**{k: self.spark.createDataFrame([], TABLES[k]) for k in ("associations", "arrays", "timestamp_sets")})
        else:
            gone = ListFilter(owner_id=owner_id, owner_category=category).column()
            self._change(associations=self.associations.where(~gone))

    def _checked(self, after: DataFrame) -> None:
        """Publish a changed catalog if identities and families still hold."""
        if after.groupBy(*sets.IDENTITY).count().where("count > 1").limit(1).count():
            raise DuplicateTimeSeries("two series would have one identity")
        if sets.family_conflicts(after, after).limit(1).count():
            raise DuplicateTimeSeries("a family would hold dense and derived forecasts")
        self._change(associations=after)

    def _may_add(self, new: DataFrame) -> None:
        if sets.duplicates(new, self.associations).limit(1).count():
            raise DuplicateTimeSeries("two series would have one identity")
        if sets.family_conflicts(new, self.associations).limit(1).count():
            raise DuplicateTimeSeries("a family would hold dense and derived forecasts")

    def rename(self, f: ListFilter, name: str) -> None:
        row = resolve_one(self.associations, f)
        self._checked(self.associations.withColumn("name", F.when(F.col("assoc_id") == row["assoc_id"], F.lit(name)).otherwise(F.col("name"))))

    def copy(self, f: ListFilter, owner_id: int, owner_type: str, name: str | None = None) -> None:
        """A new row on the same array."""
        row = resolve_one(self.associations, f)
        top = self.associations.agg(F.max("assoc_id")).first()[0] + 1
        new = self.associations.where(F.col("assoc_id") == row["assoc_id"]).withColumns(
            {
                "assoc_id": F.lit(top).cast("long"),
                "owner_id": F.lit(owner_id).cast("long"),
                "owner_type": F.lit(owner_type),
                "name": F.lit(name or row["name"]),
            },
        )
        self._may_add(new)
        self._append(associations=new)

    def replace_owner(self, old: int, new: int, category: str = "Component") -> None:
        """All series of an owner go to another; their owner_type stays."""
        moves = (F.col("owner_id") == old) & (F.col("owner_category") == category)
        self._checked(self.associations.withColumn("owner_id", F.when(moves, F.lit(new).cast("long")).otherwise(F.col("owner_id"))))

    def transform(self, horizon: str, interval: str, dry_run: bool = False, **options) -> int:
        """Derive views of all single series; how many are new."""
        new = series.transform(self.associations, Period.parse(horizon), Period.parse(interval), **options)
        first = (self.associations.agg(F.max("assoc_id")).first()[0] or 0) + 1
        if dry_run:
            return new.count()
        rows = written(new.withColumn("assoc_id", F.lit(first) + F.monotonically_increasing_id()), "views")
        self._append(associations=rows.select(*self.associations.columns))
        return rows.count()

    def link(self, rows: list[tuple], table: str = "attribute_links") -> None:
        """rows: (id, type, id, type) of both ends."""
        ends = links.ATTRIBUTES if table == "attribute_links" else links.EDGES
        first = (self.tables[table].agg(F.max("id")).first()[0] or 0) + 1
        new = self.spark.createDataFrame([(first + i, *r) for i, r in enumerate(rows)], TABLES[table])
        links.check_new(self.tables[table], new, ends)
        self._append(**{table: new})

    def verify(self) -> DataFrame:
        """(assoc_id, problem) of every rule that a row, its array or its timestamps break."""
        return diagnostics.verified(self.associations, self.tables["arrays"], self.tables["timestamp_sets"])


def _stored(v) -> tuple:
    if isinstance(v, bool):
        return ("bool", None, None, v, None)
    if isinstance(v, int):
        return ("int", v, None, None, None)
    if isinstance(v, float):
        return ("float", None, v, None, None)
    return ("str", None, None, None, v)


def _decimals(values):
    from decimal import Decimal

    return None if values is None else [Decimal(v) for v in values]
