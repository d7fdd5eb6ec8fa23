"""Catalog filters as one predicate, which the scan can take."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameter, NotFound
from ..functions.parse import DERIVED, DETERMINISTIC, hash_prefix
from ..schema import FEATURE


def glob_regex(pattern: str) -> str:
    """An anchored regular expression of a GLOB: *, ?, [...] and [^...]; all else is literal, case counts."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[":
            j = i + 1
            negated = pattern[j : j + 1] == "^"
            j += negated
            end = pattern.find("]", j + 1)  # a ] that comes first is a member
            if end < 0:
                return r"(?!)"  # an unclosed class matches nothing
            members = re.sub(r"([\\\[\]&^])", r"\\\1", pattern[j:end])
            out.append(f"[{'^' * negated}{members}]")
            i = end + 1
            continue
        out.append({"*": "(?s:.*)", "?": "(?s:.)"}.get(c) or re.sub(r"([\\.^$|(){}+\[\]*?])", r"\\\1", c))
        i += 1
    return "^" + "".join(out) + r"\z"


def type_matches(column: Column, code: int) -> Column:
    """A request for Deterministic also takes views derived from single series; all others are exact."""
    return column.between(DETERMINISTIC, DERIVED) if code == DETERMINISTIC else column == code


def feature_value(v: int | float | bool | str) -> Column:
    """A feature value as stored; kinds never equal each other."""
    kind = "bool" if isinstance(v, bool) else {int: "int", float: "float", str: "str"}[type(v)]
    at = {"int": "i", "float": "f", "bool": "b", "str": "s"}[kind]
    fields = {"kind": F.lit(kind)} | {k: F.lit(v) if k == at else F.lit(None) for k in "ifbs"}
    return F.struct(*[c.alias(k) for k, c in fields.items()]).cast(FEATURE)


def feature_map(features: dict) -> Column:
    if not features:
        return F.expr(f"cast(map() as map<string,{FEATURE}>)")
    return F.create_map(*[x for k, v in features.items() for x in (F.lit(k), feature_value(v))])


def has_feature(features: Column, key: str, v: int | float | bool | str) -> Column:
    """Floats are equal bit by bit: -0.0 is not 0.0, NaN is NaN."""
    held = features[key]
    at, kind = ("b", "bool") if isinstance(v, bool) else {int: ("i", "int"), float: ("f", "float"), str: ("s", "str")}[type(v)]
    same = held[at] == F.lit(v)
    if isinstance(v, float) and v == 0:
        same = same & (held[at].cast("string") == F.lit(v).cast("string"))
    return F.coalesce((held["kind"] == kind) & same, F.lit(False))


@dataclass(frozen=True)
class ListFilter:
    """All conditions that are set must hold. A component field, resolution or interval of null never equals one."""

    owner_id: int | None = None
    owner_category: str | None = None
    owner_type: str | None = None
    time_series_type: int | None = None
    exact_type: bool = False
    name: str | None = None
    name_glob: str | None = None
    component_field: str | None = None
    resolution: str | None = None
    interval: str | None = None
    features: dict = field(default_factory=dict)
    features_hash: str | None = None
    data_hash: str | None = None

    def column(self) -> Column:
        out = F.lit(True)
        for name in ("owner_id", "owner_category", "owner_type", "name", "component_field", "resolution", "interval", "features_hash"):
            if (v := getattr(self, name)) is not None:
                out = out & (F.col(name) == v)
        if (t := self.time_series_type) is not None:
            out = out & (F.col("time_series_type") == t if self.exact_type else type_matches(F.col("time_series_type"), t))
        if self.name_glob is not None:
            out = out & F.col("name").rlike(glob_regex(self.name_glob))
        if self.data_hash is not None:
            out = out & F.col("data_hash").startswith(hash_prefix(self.data_hash))
        for k, v in self.features.items():
            out = out & has_feature(F.col("features"), k, v)
        return out

    def of(self, associations: DataFrame) -> DataFrame:
        return associations.where(self.column())


def endpoint(prefix: str, id_: int | None = None, types: list[str] | None = None) -> Column:
    """One end of a link: its id, or a list of types; an empty list matches nothing."""
    out = F.lit(True)
    if id_ is not None:
        out = out & (F.col(f"{prefix}_id") == id_)
    if types is not None:
        out = out & (F.col(f"{prefix}_type").isin(*types) if types else F.lit(False))
    return out


def resolve_one(associations: DataFrame, f: ListFilter):
    """The only row that matches; an error that names up to ten otherwise."""
    rows = f.of(associations).limit(11).collect()
    if not rows:
        raise NotFound(f"no series matches {f}")
    if len(rows) > 1:
        shown = ", ".join(f"{r['owner_id']}/{r['name']}/{r['resolution']}" for r in rows[:10])
        raise InvalidParameter(f"more than one series matches: {shown}{' ...' if len(rows) > 10 else ''}")
    return rows[0]
