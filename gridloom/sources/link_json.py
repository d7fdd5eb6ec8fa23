"""Links from JSON: one object a row, taken whole or refused whole.

An object must have exactly the fields of a link, each of its type. Unknown, missing or repeated fields, values of another
type, and text that is no object are problems of the row; a pair of ids that stands twice or is stored already refuses
everything too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DuplicateAssociation, InvalidParameter
from ..functions.tables import written
from ..operators.links import ATTRIBUTES


def fields(ends: tuple[str, str] = ATTRIBUTES) -> list[str]:
    return [f"{end}_{part}" for end in ends for part in ("id", "type")]


def objects(documents: DataFrame, column: str = "json") -> DataFrame:
    """(json) of the elements of JSON arrays, one array a row."""
    return documents.select(F.explode(F.from_json(column, "array<string>")).alias("json"))


def _typed(name: str) -> Column:
    """The field as its type, or null. A number in quotes is no number, and a number is no text."""
    raw, quoted = F.col(f"__raw_{name}"), F.col("__json").rlike(rf'"{name}"\s*:\s*"')
    return F.when(~quoted & raw.rlike(r"^-?[0-9]{1,19}$"), raw.try_cast("long")) if name.endswith("_id") else F.when(quoted, raw)


def parsed(rows: DataFrame, ends: tuple[str, str] = ATTRIBUTES) -> DataFrame:
    """rows (json) with a link's fields and problem, the first rule that the object breaks."""
    names = fields(ends)
    # exploded, the text is made once a row, and its fields are sought in one go, however often the rules name them
    out = rows.select("*", F.explode(F.array(F.trim("json"))).alias("__json"))
    out = out.select("*", F.json_tuple("__json", *names).alias(*[f"__raw_{name}" for name in names]))
    keys, wanted = F.coalesce(F.json_object_keys("__json"), F.array().cast("array<string>")), F.array(*map(F.lit, names))
    out = out.withColumns({"__keys": keys, "__object": F.col("__json").startswith("{")} | {name: _typed(name) for name in names})
    out = out.withColumns({"__unknown": F.array_except("__keys", wanted), "__absent": F.array_except(wanted, "__keys")})
    wrong = F.array_compact(F.array(*[F.when(F.col(name).isNull(), F.lit(name)) for name in names]))
    rules = [
        (~F.coalesce(F.col("__object"), F.lit(False)) | (F.size("__keys") == 0), F.lit("no object")),
        (F.size("__unknown") > 0, F.concat(F.lit("unknown field "), F.array_join("__unknown", ", "))),
        (F.size("__absent") > 0, F.concat(F.lit("missing field "), F.array_join("__absent", ", "))),
        (F.size("__keys") > len(names), F.lit("repeated field")),
        (F.size(wrong) > 0, F.concat(F.lit("wrong type of "), F.array_join(wrong, ", "))),
    ]
    problem = F.coalesce(*[F.when(rule, text) for rule, text in rules])
    return out.withColumn("problem", problem).drop("__json", "__keys", "__object", "__unknown", "__absent", *[f"__raw_{name}" for name in names])


def problems(rows: DataFrame, stored: DataFrame, ends: tuple[str, str] = ATTRIBUTES) -> DataFrame:
    """(json, problem) of every row that would be refused; pairs that repeat, or that are stored, are named each."""
    return _refused(written(parsed(rows, ends), "links"), stored, ends)


def _refused(found: DataFrame, stored: DataFrame, ends: tuple[str, str]) -> DataFrame:
    """problems() of parsed rows, which are read twice."""
    ids = [f"{end}_id" for end in ends]
    sound = found.where("problem is null")
    again = F.when(F.count(F.lit(1)).over(Window.partitionBy(*ids)) > 1, F.lit("repeated pair"))
    taken = stored.select(*ids, F.lit("stored pair").alias("__taken"))
    pairs = sound.withColumn("problem", again).join(taken, ids, "left").withColumn("problem", F.coalesce("problem", "__taken"))
    broken = found.where("problem is not null").select("json", "problem")
    return broken.union(pairs.where("problem is not null").select("json", "problem"))


def imported(rows: DataFrame, stored: DataFrame, ends: tuple[str, str] = ATTRIBUTES) -> DataFrame:
    """stored with the links of rows, which follow in no particular order; an error, and nothing, if one row has a problem."""
    found = written(parsed(rows, ends), "links")
    bad = _refused(found, stored, ends).limit(1).collect()
    if bad:
        kind = DuplicateAssociation if bad[0]["problem"].endswith("pair") else InvalidParameter
        raise kind(f"{bad[0]['problem']}: {bad[0]['json'][:200]}")
    first = (stored.agg(F.max("id")).first()[0] or 0) + 1
    new = found.select((F.lit(first) + F.monotonically_increasing_id()).alias("id"), *fields(ends))
    return stored.select("id", *fields(ends)).unionByName(new)
