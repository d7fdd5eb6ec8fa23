"""Element types: what the values of one step mean, and flat rows to logical values and back."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from .hashing import DTYPES

#: Spark types of dtypes, and element types in their order (fixed values).
SPARK = {
    "f64": "double",
    "f32": "float",
    "i64": "bigint",
    "i32": "int",
    "u64": "decimal(20,0)",
    "bool": "boolean",
    "i16": "smallint",
    "i8": "tinyint",
    "u32": "bigint",
    "u16": "int",
    "u8": "smallint",
}
FUNCTIONS = ("linear_function", "quadratic_function", "piecewise_linear", "piecewise_step")
DIMS = {"linear_function": 2, "quadratic_function": 3}


@dataclass(frozen=True)
class ElementType:
    kind: str  # scalar, tuple or one of FUNCTIONS
    dtype: str = "f64"
    arity: int = 0

    @staticmethod
    def parse(text: str) -> ElementType:
        """A dtype, tuple(N,dtype) or a function kind; case and underscores do not matter."""
        t = text.strip().lower()
        for f in FUNCTIONS:
            if t.replace("_", "") == f.replace("_", ""):
                return ElementType(f)
        if t in DTYPES:
            return ElementType("scalar", t)
        if (m := re.fullmatch(r"tuple\((\d+),\s*(\w+)\)", t)) and int(m[1]) and m[2] in DTYPES:
            return ElementType("tuple", m[2], int(m[1]))
        raise InvalidParameter(f"unknown element type: {text!r}")

    def __str__(self) -> str:
        return self.dtype if self.kind == "scalar" else f"tuple({self.arity},{self.dtype})" if self.kind == "tuple" else self.kind

    @property
    def ragged(self) -> bool:
        return self.kind.startswith("piecewise")

    @property
    def fixed_dims(self) -> int | None:
        return self.arity if self.kind == "tuple" else DIMS.get(self.kind)

    def sort_key(self) -> tuple:
        """Order of declaration, not of text."""
        return (("scalar", "tuple", *FUNCTIONS).index(self.kind), self.arity, list(DTYPES).index(self.dtype))

    def check_shape(self, dtype: str, dims: list[int]) -> None:
        """dims: the axes of one step."""
        if dtype != self.dtype:
            raise InvalidParameter(f"{self} holds {self.dtype}, not {dtype}")
        if self.kind == "scalar":
            return
        ok = len(dims) == 1 and (
            dims[0] == self.fixed_dims if not self.ragged else dims[0] % 2 == 1 if self.kind == "piecewise_linear" else dims[0] == 1 or dims[0] >= 2 and dims[0] % 2 == 0
        )
        if not ok:
            raise InvalidParameter(f"{self} cannot have steps of shape {dims}")


def rows_of(values: Column, width: int) -> Column:
    """A flat array as rows of width values."""
    n = F.size(values) / width
    return F.when(F.size(values) == 0, F.array().cast("array<array<double>>")).otherwise(
        F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda r: F.slice(values, r * width + 1, F.lit(width))),
    )


def valid(values: Column, element: ElementType, width: int) -> Column:
    """Whether each row's leading count is finite, whole, not negative and fits the width."""
    if not element.ragged:
        return F.lit(True)
    most = (width - 1) // 2 if element.kind == "piecewise_linear" else width // 2
    return F.forall(
        rows_of(values, width),
        lambda r: ~F.isnan(r[0]) & (F.abs(r[0]) < float("inf")) & (r[0] >= 0) & (F.floor(r[0]) == r[0]) & (r[0] <= most),
    )


def decoded(values: Column, element: ElementType, width: int) -> Column:
    """An array with the logical value of each row."""
    at = lambda r, i: F.element_at(r, i)
    if element.kind == "linear_function":
        one = lambda r: F.struct(at(r, 1).alias("proportional"), at(r, 2).alias("constant"))
    elif element.kind == "quadratic_function":
        one = lambda r: F.struct(at(r, 1).alias("quadratic"), at(r, 2).alias("proportional"), at(r, 3).alias("constant"))
    elif element.kind == "piecewise_linear":
        none = F.expr("cast(array() as array<struct<x:double,y:double>>)")
        one = lambda r: F.when(r[0] == 0, none).otherwise(
            F.transform(F.sequence(F.lit(1), r[0].cast("int")), lambda i: F.struct(at(r, 2 * i).alias("x"), at(r, 2 * i + 1).alias("y"))),
        )
    elif element.kind == "piecewise_step":
        one = lambda r: F.struct(
            F.slice(r, 2, r[0].cast("int")).alias("x"),
            F.slice(r, r[0].cast("int") + 2, F.greatest(r[0].cast("int") - 1, F.lit(0))).alias("y"),
        )
    elif element.kind == "tuple":
        one = lambda r: r
    else:
        return values
    return F.transform(rows_of(values, width), one)


def encoded(logical: Column, element: ElementType) -> Column:
    """The flat array of logical values, rows padded with zeros to the widest."""
    if element.kind == "linear_function":
        return F.flatten(F.transform(logical, lambda x: F.array(x["proportional"], x["constant"])))
    if element.kind == "quadratic_function":
        return F.flatten(F.transform(logical, lambda x: F.array(x["quadratic"], x["proportional"], x["constant"])))
    if element.kind == "piecewise_linear":
        rows = F.transform(
            logical,
            lambda x: F.concat(F.array(F.size(x).cast("double")), F.flatten(F.transform(x, lambda p: F.array(p["x"], p["y"])))),
        )
    elif element.kind == "piecewise_step":
        rows = F.transform(logical, lambda x: F.concat(F.array(F.size(x["x"]).cast("double")), x["x"], x["y"]))
    else:
        return F.flatten(logical)
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    return F.flatten(F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(0.0), width - F.size(r)))))


def as_doubles(values: str = "values", exact: str = "exact") -> Column:
    """An array of any dtype as doubles: 64-bit integers, kept exactly until here, may lose their last digits."""
    return F.coalesce(F.transform(values, lambda x: x.cast("double")), F.transform(exact, lambda x: x.cast("double")))
