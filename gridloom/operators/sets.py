"""Two catalogs against each other, and guards that look across rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import DERIVED, DETERMINISTIC, SINGLE
from ..functions.tables import held
from ..schema import IDENTITY


def _same(a: str, b: str):
    out = F.lit(True)
    for c in IDENTITY:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def diff(left: DataFrame, right: DataFrame, everything: bool = False) -> DataFrame:
    """Identities with status added, removed, changed (or same), by their array hashes."""
    j = left.alias("l").join(right.alias("r"), _same("l", "r"), "full_outer")
    status = F.when(F.col("l.data_hash").isNull(), "added").when(F.col("r.data_hash").isNull(), "removed").when(
        F.col("l.data_hash") == F.col("r.data_hash"),
        "same",
    ).otherwise("changed")
    out = j.select(*[F.coalesce(F.col(f"l.{c}"), F.col(f"r.{c}")).alias(c) for c in IDENTITY], status.alias("status"))
    return out if everything else out.where(F.col("status") != "same")


def merge(into: DataFrame, other: DataFrame, replace: bool = False) -> DataFrame:
    """into with other's series; of equal identities that of other if replace, else that of into. Views land as dense forecasts."""
    other = other.withColumn(
        "time_series_type",
        F.when(F.col("time_series_type") == DERIVED, F.lit(DETERMINISTIC)).otherwise(F.col("time_series_type")),
    )
    first, second = (other, into) if replace else (into, other)
    rest = second.alias("l").join(first.alias("r"), _same("l", "r"), "left_anti").select("l.*")
    return first.unionByName(rest)


def duplicates(new: DataFrame, associations: DataFrame) -> DataFrame:
    """New rows whose identity is stored, or stands in the batch before them."""
    nth = F.row_number().over(Window.partitionBy(*IDENTITY).orderBy("assoc_id"))
    inside = new.withColumn("__nth", nth).where("__nth > 1").drop("__nth")
    return new.alias("l").join(associations.alias("r"), _same("l", "r"), "left_semi").select("l.*").union(inside).dropDuplicates(["assoc_id"])


FAMILY = ("owner_id", "owner_category", "name", "resolution", "features_hash")


def family_conflicts(new: DataFrame, associations: DataFrame) -> DataFrame:
    """New forecasts whose family holds the other kind: dense and derived never mix, whatever their intervals."""
    kinds = (DETERMINISTIC, DERIVED)
    n, a = new.where(F.col("time_series_type").isin(*kinds)).alias("n"), associations.where(F.col("time_series_type").isin(*kinds)).alias("a")
    same = F.col("n.time_series_type") + F.col("a.time_series_type") == DETERMINISTIC + DERIVED
    for c in FAMILY:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"a.{c}"))
    return n.join(a, same, "left_semi").select("n.*")


def owner_move_conflicts(associations: DataFrame, old: int, new: int, category: str = "Component") -> DataFrame:
    """The forecasts of an owner that would meet the other kind of their family if they went to another owner of the category."""
    of = lambda owner: associations.where((F.col("owner_id") == owner) & (F.col("owner_category") == category))
    return family_conflicts(of(old).withColumn("owner_id", F.lit(new).cast("long")), of(new))


def orphans(shared: DataFrame, associations: DataFrame, key: str) -> DataFrame:
    """Shared rows (arrays, timestamp vectors) that no series refers to."""
    return shared.join(associations.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def orphaned_views(associations: DataFrame) -> DataFrame:
    """Arrays that only derived views refer to."""
    refs = associations.groupBy("data_hash").agg(
        F.count_if(F.col("time_series_type") == DERIVED).alias("derived"),
        F.count_if(F.col("time_series_type") == SINGLE).alias("static"),
    )
    return refs.where("derived > 0 and static = 0").select("data_hash")


def first_rows(rows: DataFrame) -> DataFrame:
    """(data_hash, __row): the first row of each hash in a written table whose rows are numbered. Only hashes and numbers are grouped."""
    return rows.groupBy("data_hash").agg(F.min("__row").alias("__row"))


def chosen(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """The rows of such a table that numbers (__row) name, with their arrays."""
    return rows.join(held(numbers.select("__row")), "__row", "left_semi")


def deduplicated(arrays: DataFrame, stored: DataFrame) -> DataFrame:
    """New arrays once each, without those that are stored."""
    return arrays.dropDuplicates(["data_hash"]).join(stored.select("data_hash"), "data_hash", "left_anti")
