"""Content hashes of arrays, feature sets and timestamp vectors (SHA-256 over fixed byte layouts)."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import IntegrityError
from .period import EPOCH

#: numpy types by dtype name, and delta units of the timestamp layout in nanoseconds (fixed values).
DTYPES = {
    "f64": "<f8",
    "f32": "<f4",
    "i64": "<i8",
    "i32": "<i4",
    "u64": "<u8",
    "bool": "?",
    "i16": "<i2",
    "i8": "i1",
    "u32": "<u4",
    "u16": "<u2",
    "u8": "u1",
}
UNITS = (1, 10**3, 10**6, 10**9, 60 * 10**9, 3600 * 10**9, 86400 * 10**9)


def array_hash(dtype: str, shape: list[int], values) -> str:
    """Over dtype, rank, dimensions and little-endian elements; every NaN counts as the same one."""
    a = np.array([int(v) for v in values], np.uint64) if dtype == "u64" else np.asarray(values).astype(DTYPES[dtype])
    if dtype in ("f64", "f32"):
        a = np.where(np.isnan(a), np.array(np.nan, a.dtype), a)
    head = dtype.encode() + b"\0" + struct.pack(f"<Q{len(shape)}Q", len(shape), *shape)
    return hashlib.sha256(head + np.ascontiguousarray(a).tobytes()).hexdigest()


def features_hash(features: dict) -> str:
    """Over the sorted keys, each with a kind tag and its value."""
    h = hashlib.sha256(b"features\0" + struct.pack("<Q", len(features)))
    for key in sorted(features, key=str.encode):
        v, k = features[key], key.encode()
        h.update(struct.pack("<Q", len(k)) + k)
        if isinstance(v, bool):
            h.update(b"b" + bytes([v]))
        elif isinstance(v, int):
            h.update(b"i" + struct.pack("<q", v))
        elif isinstance(v, float):
            h.update(b"f" + struct.pack("<d", math.nan if math.isnan(v) else v))
        else:
            h.update(b"s" + struct.pack("<Q", len(v.encode())) + v.encode())
    return h.hexdigest()


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _zigzag(n: int) -> bytes:
    return _varint(2 * n if n >= 0 else -2 * n - 1)


def timestamps_blob(times: list[dt.datetime]) -> bytes:
    """Version, unit, count, first instant, then differences in the coarsest unit that divides them all."""
    nanos = [(t - EPOCH) // dt.timedelta(microseconds=1) * 1000 for t in times]
    deltas = [b - a for a, b in zip(nanos, nanos[1:], strict=False)]
    step = math.gcd(*deltas) if deltas else 0
    unit = max(i for i, u in enumerate(UNITS) if step % u == 0)
    out = bytes([1, unit]) + _varint(len(nanos))
    if nanos:
        seconds, rest = divmod(nanos[0], 10**9)
        out += _zigzag(seconds) + _varint(rest) + b"".join(_zigzag(d // UNITS[unit]) for d in deltas)
    return out


def timestamps_of(blob: bytes) -> list[dt.datetime]:
    """The instants of a blob; an error unless it is read to its last byte."""
    at = 2

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            byte = blob[at]
            at += 1
            n |= (byte & 0x7F) << shift
            if byte < 0x80:
                return n
            shift += 7

    signed = lambda n: n >> 1 if n % 2 == 0 else -(n + 1) // 2
    if len(blob) < 3 or blob[0] != 1 or blob[1] >= len(UNITS):
        raise IntegrityError("not a timestamp vector of version 1")
    try:
        count = varint()
        nanos = []
        if count:
            seconds = signed(varint())
            nanos = [seconds * 10**9 + varint()]
            for _ in range(count - 1):
                nanos.append(nanos[-1] + signed(varint()) * UNITS[blob[1]])
    except IndexError:
        raise IntegrityError("a timestamp vector ends early") from None
    if at != len(blob):
        raise IntegrityError("a timestamp vector has bytes after its end")
    return [EPOCH + dt.timedelta(microseconds=n // 1000) for n in nanos]


def encoded_timestamps(times: Column) -> Column:
    """The blob of an array of instants."""
    @F.pandas_udf("binary")
    def blob(micros: pd.Series) -> pd.Series:
        return pd.Series([timestamps_blob([EPOCH + dt.timedelta(microseconds=int(x)) for x in m]) for m in micros])

    return blob(F.transform(times, lambda t: F.unix_micros(t.cast("timestamp"))))


def decoded_timestamps(blobs: Column) -> Column:
    @F.pandas_udf("array<bigint>")
    def micros(of: pd.Series) -> pd.Series:
        return pd.Series([[(t - EPOCH) // dt.timedelta(microseconds=1) for t in timestamps_of(bytes(b))] for b in of])

    return F.transform(micros(blobs), lambda x: F.timestamp_micros(x).cast("timestamp_ntz"))


def timestamps_hash(times: list[dt.datetime]) -> str:
    return hashlib.sha256(b"timestamps\0" + timestamps_blob(times)).hexdigest()


def content_hash(dtype: Column, shape: Column, values: Column, exact: Column) -> Column:
    """array_hash of columns, over exact where it is not null; values are slices of a batch's one vector, and no row is converted."""
    @F.arrow_udf("string")
    def hashed(dtypes: pa.Array, shapes: pa.Array, arrays: pa.Array, exacts: pa.Array) -> pa.Array:
        flat, at, there = arrays.values.to_numpy(zero_copy_only=False), arrays.offsets.to_pylist(), arrays.is_valid().to_pylist()
        rows = zip(dtypes.to_pylist(), shapes.to_pylist(), exacts.to_pylist(), strict=True)
        of = lambda i: flat[at[i] : at[i + 1]] if there[i] else None
        return pa.array([array_hash(d, s, of(i) if e is None else [int(x) for x in e]) for i, (d, s, e) in enumerate(rows)], pa.string())

    return hashed(dtype, shape, values, exact)


def array_hash_column(dtype: str, shape: Column, values: Column) -> Column:
    """array_hash of columns of one dtype."""
    return content_hash(F.lit(dtype), shape, values, F.lit(None).cast("array<decimal(20,0)>"))


def timestamps_hash_column(times: Column) -> Column:
    """timestamps_hash of an array of instants."""
    @F.arrow_udf("string")
    def hashed(micros: pa.Array) -> pa.Array:
        return pa.array([timestamps_hash([EPOCH + dt.timedelta(microseconds=x) for x in m]) for m in micros.to_pylist()], pa.string())

    return hashed(F.transform(times, lambda t: F.unix_micros(t.cast("timestamp"))))
