"""Attribute links and component edges: two tables of pairs with types at both ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DuplicateAssociation
from .filters import endpoint

ATTRIBUTES, EDGES = ("component", "attribute"), ("parent", "child")


def check_new(links: DataFrame, new: DataFrame, ends: tuple[str, str] = ATTRIBUTES) -> None:
    """A pair of ids may stand once, whatever the types say."""
    ids = [f"{e}_id" for e in ends]
    if new.groupBy(*ids).count().where("count > 1").limit(1).count() or new.join(links, ids, "left_semi").limit(1).count():
        raise DuplicateAssociation("a pair is linked already")


def added(links: DataFrame, new: DataFrame, ends: tuple[str, str] = ATTRIBUTES) -> DataFrame:
    """links and new, all or nothing."""
    check_new(links, new, ends)
    return links.unionByName(new)


def listed(links: DataFrame, ends: tuple[str, str] = ATTRIBUTES, first: dict | None = None, second: dict | None = None) -> DataFrame:
    """Links by conditions on either end ({id_, types}), in the order of insertion."""
    return links.where(endpoint(ends[0], **(first or {})) & endpoint(ends[1], **(second or {}))).orderBy("id")


def ids(links: DataFrame, end: str, **other) -> DataFrame:
    """Distinct ids at one end, ascending; other: conditions as for listed()."""
    return listed(links, **other).select(f"{end}_id").distinct().orderBy(f"{end}_id")


def counts(links: DataFrame, ends: tuple[str, str] = ATTRIBUTES) -> DataFrame:
    return links.agg(F.count(F.lit(1)).alias("links"), *[F.countDistinct(f"{e}_id").alias(f"{e}s") for e in ends])


def counts_by_type(links: DataFrame, end: str) -> DataFrame:
    return links.groupBy(f"{end}_type").agg(F.count(F.lit(1)).alias("links")).orderBy(f"{end}_type")


def summary(links: DataFrame, ends: tuple[str, str] = ATTRIBUTES) -> DataFrame:
    by = [f"{ends[1]}_type", f"{ends[0]}_type"]
    return links.groupBy(*by).agg(F.count(F.lit(1)).alias("links")).orderBy(*by)


def removed(links: DataFrame, ends: tuple[str, str] = ATTRIBUTES, first: dict | None = None, second: dict | None = None) -> DataFrame:
    return links.where(~(endpoint(ends[0], **(first or {})) & endpoint(ends[1], **(second or {}))))


def reassigned(links: DataFrame, old: int, new: int) -> DataFrame:
    """Attribute links of component old as those of new, with new's type if it has links; a collision is an error."""
    if old == new:
        return links
    label = links.where(F.col("component_id") == new).orderBy("id").limit(1).select(F.col("component_type").alias("__type"))
    moving = links.where(F.col("component_id") == old)
    taken = links.where(F.col("component_id") == new).select("attribute_id")
    if moving.join(taken, "attribute_id", "left_semi").limit(1).count():
        raise DuplicateAssociation("an attribute is linked to both components")
    to = [r[0] for r in label.collect()]
    kind = F.lit(to[0]) if to else F.col("component_type")
    moves = F.col("component_id") == old
    return links.withColumns(
        {
            "component_type": F.when(moves, kind).otherwise(F.col("component_type")),
            "component_id": F.when(moves, F.lit(new).cast("long")).otherwise(F.col("component_id")),
        },
    )


def edges_reassigned(edges: DataFrame, old: int, new: int) -> DataFrame:
    """Both ends of edges from old to new at once."""
    if old == new:
        return edges
    out = edges.withColumns({c: F.when(F.col(c) == old, F.lit(new).cast("long")).otherwise(F.col(c)) for c in ("parent_id", "child_id")})
    if out.groupBy("parent_id", "child_id").count().where("count > 1").limit(1).count():
        raise DuplicateAssociation("two edges would become one")
    return out
