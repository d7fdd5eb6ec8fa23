"""Feature sets apart from the catalog: a table with one row a distinct set, which associations name by hash.

Conditions on features are then evaluated once a distinct set, and a semi join keeps the associations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import has_feature


def split(associations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(associations without features, the sets (features_hash, features))."""
    sets = associations.select("features_hash", "features").where(F.col("features_hash").isNotNull())
    return associations.drop("features"), sets.dropDuplicates(["features_hash"])


def hydrated(associations: DataFrame, sets: DataFrame) -> DataFrame:
    """Associations with their features; one whose set is not stored has none."""
    return associations.join(sets, "features_hash", "left")


def _holds(features: dict):
    out = F.lit(True)
    for key, value in features.items():
        out = out & has_feature(F.col("features"), key, value)
    return out


def with_features(associations: DataFrame, sets: DataFrame, features: dict) -> DataFrame:
    """Associations whose set holds all of features, among others."""
    if not features:
        return associations
    return associations.join(sets.where(_holds(features)).select("features_hash"), "features_hash", "left_semi")


def with_exactly(associations: DataFrame, sets: DataFrame, features: dict) -> DataFrame:
    """Associations whose set is features and nothing else."""
    same = sets.where((F.size("features") == len(features)) & _holds(features))
    return associations.join(same.select("features_hash"), "features_hash", "left_semi")


def missing(associations: DataFrame, sets: DataFrame) -> DataFrame:
    """Associations whose set is not stored."""
    return associations.where(F.col("features_hash").isNotNull()).join(sets, "features_hash", "left_anti")
